"""Operators that learn, by held-out accuracy; decontamination; the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, langid, quality, queries
from tessera.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the the " * 30000), (4, "the the " * 30000), (None, "und der die das"), (6, "²½")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))


def test_language_held_out(spark, docs):
    got = queries.op3_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_corner_cases(spark, docs):
    model = langid.train(docs, "text", "lang")
    got = {(r.doc_id, r.text): r for r in langid.identify(odd(spark), model).collect()}
    assert len(got) == 6 and langid.identify(odd(spark), model).count() == 7
    assert [got[k].lang_pred for k in [(1, None), (2, ""), (3, "12 34 !!"), (6, "²½")]] == ["und"] * 4
    assert got[(4, "the the " * 30000)].lang_pred == "en" and got[(None, "und der die das")].lang_pred == "de"
    empty = langid.train(docs.limit(0), "text", "lang")
    assert {r.lang_pred for r in langid.identify(odd(spark), empty).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'fr'"), "text", "lang")
    assert {r.lang_pred for r in langid.identify(odd(spark), one).collect()} == {"und", "fr"}
    assert langid.identify(odd(spark).limit(0), model).count() == 0


def test_near_ties_of_languages_are_ambiguous(spark):
    model = langid.train(spark.createDataFrame([("aa aa aa", "x"), ("bb bb bb", "y")], "text string, lang string"), "text", "lang")
    texts = spark.createDataFrame([("zz qq",), ("aa aa",), ("bb bb bb",), ("",)], "text string")
    assert {r.text: r.ambiguous for r in langid.identify(texts, model).collect()} == {"zz qq": True, "aa aa": False, "bb bb bb": False, "": True}


def test_mixed_and_foreign_texts_are_ambiguous_and_pure_ones_are_not(spark, docs):
    held = docs.where((fold(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull() & (F.length("text") > 400))
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2), "text", "lang")
    by = {k: [r.text for r in held.where(F.col("lang") == k).collect()] for k in ("de", "en", "es", "fr")}
    pure = [t for texts in by.values() for t in texts]
    mixed = [x[:300] + " " + y[:300] for a in by for b in by if a < b for x, y in zip(by[a], by[b])]
    foreign = ["привет мир как дела сегодня хорошая погода", "これは日本語です", "ελληνικά γράμματα είναι εδώ", "lorem ipsum dolor sit amet consectetur"]
    rows = [(t, k) for k, texts in (("pure", pure), ("mixed", mixed), ("foreign", foreign)) for t in texts]
    got = langid.identify(spark.createDataFrame(rows, "text string, kind string"), model).groupBy("kind").agg(F.avg(F.col("ambiguous").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    share = {r.kind: r.share for r in got}
    assert share["foreign"] == 1 and share["mixed"] > 0.9 and share["pure"] < 0.01 and min(r.n for r in got if r.kind != "foreign") > 20


@pytest.mark.parametrize("k", [2, 3, 5, 6, 20])
def test_codewords_differ_and_bits_split(k):
    code = langid.codewords(k)
    assert len({tuple(r) for r in code.tolist()}) == k
    assert (np.abs(code.sum(axis=0, dtype=int)) < k).all()
    apart = [int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)]
    assert min(apart) >= (1 if k == 2 else 2)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op5_quality(spark, SF).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_corner_cases(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, None), (None, 1), (0, 0), (0, 1)], "doc_id long, quality int")
    for rows in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality.score(odd(spark), quality.train(docs, rows))
        assert got.count() == 7 and got.where("score between 0 and 1").count() == 7
    assert quality.score(odd(spark).limit(0), quality.train(docs, labels)).count() == 0


def test_quality_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.WIDTH)) for n in (1, 3, 2)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    net = quality.fit(bags, y)
    x, sizes = np.concatenate(bags), np.array([1, 3, 2])
    loss = lambda: float((np.logaddexp(0, z := net.forward(x, sizes)[0]) - y * z).mean())
    g = net.gradient(x, sizes, y, w)
    for k, v in net.p.items():
        at = np.unravel_index(int(np.abs(g[k]).argmax()), v.shape)
        keep, e = v[at], 1e-5
        v[at] = keep + e
        up = loss()
        v[at] = keep - e
        down = loss()
        v[at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-8)


ITEM = "A farmer sells 12 crates to Alice for 30 dollars and keeps 4 kg of the apples for winter"


def test_templates(spark):
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "short one of five words"), (10, "")], "item_id long, text string")
    rows = {
        1: ITEM,
        2: "Once: a farmer sells 15 crates to Maria for 45 dollars and keeps 9 kg of the apples for winter.",
        3: "a farmer sells crates and apples to many people for a fair price each winter",
        4: None, 5: "", 6: (ITEM + " ") * 3000, 7: "Then a short one of five words came", 8: "12 30 4 5 6 7 8 9 10 11 12 13",
    }
    df = spark.createDataFrame([*rows.items(), (1, ITEM), (None, ITEM)], "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("place", F.lit(1))
    for limit in (decontaminate.FILTERED, 0):
        decontaminate.FILTERED, kept = limit, decontaminate.FILTERED
        got = [(r.doc_id, r.contaminated) for r in decontaminate.contaminated(df, bench).collect()]
        decontaminate.FILTERED = kept
        assert sorted(got, key=repr) == sorted([(1, True)] * 2 + [(2, True), (3, False), (4, False), (5, False), (6, True), (7, True), (8, False), (None, False)], key=repr)
    exact = {r.doc_id: r.exact for r in decontaminate.matches(df, bench).collect()}
    assert exact[1] and not exact[2]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_short_and_dense_items(spark):
    dense = "60 km in 2 hours and 90 km in 3 hours gives 30 km"
    bench = spark.createDataFrame([(1, "Name seven colours of the rainbow"), (2, dense), (3, "short one of five words"), (4, "Where did Anna go after the party?")], "item_id long, text string")
    rows = {
        1: ["Then", "Name seven colours of the rainbow", "he said"], 2: ["Question:", dense, "was it"], 3: ["60 km in 2 hours and 90 km in 3 hours gives 40 km"],
        4: ["Then a short one of five words came"], 5: ["seven colours of the rainbow"], 6: ["Once more: Where did Bob go after the party? Nobody knew it then"], 7: [dense], 8: ["a short one of six words"],
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    want = {1: [1], 2: [2], 3: None, 4: [3], 5: None, 6: [4], 7: [2], 8: None}
    for limit in (decontaminate.FILTERED, 0):
        decontaminate.FILTERED, kept = limit, decontaminate.FILTERED
        got = {r.doc_id: r["items"] for r in decontaminate.contaminated(df, bench).collect()}
        decontaminate.FILTERED = kept
        assert got == want


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "We know that Tom met Tom on the way to the town")], "item_id long, text string")
    df = spark.createDataFrame([(1, "We know that Ann met Ann on the way to the town"), (2, "We know that Ann met Bob on the way to the town")], "doc_id long, text string")
    n = {r.doc_id: r.n_windows for r in decontaminate.matches(df, bench).collect()}
    assert n == {1: 5}  # of the other only the last window is sound, as it has one of the names; that isn't enough


@pytest.mark.parametrize("window", [8, 16])
def test_slots_agree_over_the_whole_match(spark, window):
    text = "the first train left the small town at {} and the second one came to the same old platform there at {} by the evening clock"
    bench = spark.createDataFrame([(1, text.format("10:30", "10:30"))], "item_id long, text string")
    rows = [(1, text.format("10:30", "10:30")), (2, text.format("11:45", "11:45")), (3, text.format("11:30", "12:30")), (4, text.format("11:30", "12:30") + " . " + text.format("9:15", "9:15"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.exact for r in decontaminate.matches(df, bench, window=window).collect()} == {1: True, 2: False, 4: False}


def brute_matches(docs, bench, window):
    """Documents and items by the rules of the module, pair by pair and place by place."""

    def words(text):
        raw = (text or "").encode().split()
        c = [decontaminate.classify(w) for w in raw]
        unit = [k == decontaminate.UNIT and i > 0 and c[i - 1][0] in (decontaminate.NUM, decontaminate.QTY) for i, (k, *_) in enumerate(c)]
        kind = [decontaminate.WORD if k == decontaminate.UNIT and not u else k for (k, *_), u in zip(c, unit)]
        start = [i == 0 or c[i - 1][3] for i in range(len(c))]
        names = {c[i][1] for i in range(len(c)) if c[i][2] and not start[i] and kind[i] == decontaminate.WORD}
        form = []
        for i, (_, bare, capital, _) in enumerate(c):
            name = kind[i] == decontaminate.WORD and capital and (not start[i] or bare in names)
            form.append(("name" if name else kind[i], bare) if name or kind[i] != decontaminate.WORD else (None, bare))
        return form

    out = set()
    forms = {i: words(t) for i, t in bench}
    for d, text in docs:
        doc = words(text)
        for item, f in forms.items():
            size = min(window, len(f))
            slots = [sum(x[0] is not None for x in f[i : i + size]) for i in range(len(f) - size + 1)] if f else []
            own = [i for i, n in enumerate(slots) if n <= size - min(decontaminate.LITERALS, size)]
            same = lambda a, b: a[0] == b[0] and (a[0] is not None or a[1] == b[1])
            good = set()
            for offset in range(-len(f), len(doc)):
                hit = [p for p in own if 0 <= p + offset <= len(doc) - size and all(same(f[p + k], doc[p + offset + k]) for k in range(size))]
                stands = {}
                for p in hit:
                    for k in range(p, p + size):
                        if f[k][0] is not None:
                            stands.setdefault(f[k][1], set()).add(doc[k + offset][1])
                if all(len(v) == 1 for v in stands.values()):
                    good |= set(hit)
            if own and (len(good) >= decontaminate.SHARE * len(own) or len(good) >= decontaminate.RUN):
                out.add((d, item))
    return out


def test_templates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = "the a farmer sells buys crates of apples to for and keeps in winter house road with many old red is at".split()

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(str(rng.integers(2, 6)) if x < 0.08 else str(rng.choice(["Tom", "Ann", "Bob"])) if x < 0.16 else f"{rng.integers(2, 4)}:30" if x < 0.2 else str(rng.choice(vocabulary)))
        return out

    items = [(i, sentence(int(rng.integers(8, 22)))) for i in range(12)]
    docs = []
    for d in range(120):
        words = sentence(int(rng.integers(0, 10)))
        for _ in range(int(rng.integers(1, 3))):
            copy = list(items[int(rng.integers(0, 12))][1])
            swap = {v: str(rng.choice(["Eve", "Joe"] if v.isalpha() else ["7:15", "8:15"] if ":" in v else ["17", "18"])) for v in copy if not v.isalpha() or v.istitle()}
            copy = [swap[w] if w in swap and rng.random() < (0.95 if d % 2 else 0.6) else w for w in copy]
            at = int(rng.integers(0, len(copy)))
            words += (copy if rng.random() < 0.5 else copy[:at] + ["broken"] + copy[at:]) + sentence(3)
        docs.append((d, " ".join(words)))
    items = [(i, " ".join(t)) for i, t in items]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_matches(docs, items, decontaminate.WINDOW)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == want and 40 < len(want) < 240


def test_passages_of_the_benchmark_are_found(spark, docs):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: any(b in r.text for b in bench) for r in docs.collect()}
    got = {r.doc_id: r.contaminated for r in queries.op7_decontaminate(spark, SF).collect()}
    assert got == want and any(want.values())


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.columns[0] == "doc_id" and 0.6 * n < out.count() < n and out.select("doc_id").distinct().count() == out.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_stages_on_odd_documents(spark, sf):
    long = "and then the of with this was on that are for " * 4000
    rows = [
        (1, None, "en", "s", 1), (2, "", None, "s", None), (3, long, "en", None, 5), (4, long + "x", None, "s", 5), (4, long + "x", None, "s", 5), (None, "and the of with this", "en", "s", 2),
        (6, "mail the man at a.b@c.de for this and that", "en", "s", 9), (7, "123", "xx", "s", 3),
    ]
    from tessera.llm.common import checkpoint

    train = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 10")
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = odd.unionByName(train).withColumn("block", F.lit("clash"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        df = checkpoint(stage(spark, df, sf))
        left[name] = sorted((r.doc_id for r in df.where("doc_id < 10 or doc_id is null").collect()), key=repr)
        if name != "bpe":
            assert df.columns == corpus_pipeline.COLUMNS
    assert left["language_id"] == [3, 4, 4, 6, None]
    assert left["near_dedup"] == left["decontaminate"] == left["pii"] == left["bpe"] == [3, 6, None]
    empty = spark.createDataFrame([], odd.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = checkpoint(stage(spark, empty, sf))
        assert empty.count() == 0


def test_registered_queries_have_their_columns(spark, sf):
    assert [int(n[2:].split("_")[0]) for n in sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
