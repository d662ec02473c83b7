"""Operators with exact contracts, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from tessera.llm import bpe, html, media, pii, ppm, queries, simhash, substrings
from tessera.llm.common import ensure_checkpoint_dir
from tessera.llm.components import components

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet consectetur 4111 1111 1111 1111 a.b@c.de " * 3000
COMMON = " ".join(f"common{i}" for i in range(40))
TEXTS = [
    "plain words of one document that nobody else has, with 12 numbers",
    COMMON + " first tail",
    "head of two " + COMMON,
    COMMON + " first tail",
    "", None, " \n\t ", "one", "one two", "é ü 🙂 中文字 " + COMMON[:90], "x" * 3000, LONG, LONG + "end", COMMON, "THE the The " * 20,
    "mail me: a.b+c@d-e.co.uk or +1 (555) 123-4567, ip 10.0.255.1 not 10.0.256.1, card 4111-1111-1111-1111.",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids in no order, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("block", "fp", "ids", "decoded", "score", "lang_pred", "spans", "base", "shard", "h", "place", "bucket", "held_out", "n", "url"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, block string")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_bpe_equals_the_library(spark, docs, nothing):
    lib = Library.from_file(PATH)
    both = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH)
    assert set(both.columns) == set(docs.columns)
    for r in both.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    once = bpe.bpe_round_trip(docs, PATH)
    assert sorted(map(repr, once.select(both.columns).collect())) == sorted(map(repr, both.collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in once.collect()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.bpe_digests(docs, PATH, keep=["doc_id"]).collect())
    assert bpe.bpe_encode(nothing, PATH).count() == 0 == bpe.bpe_round_trip(nothing, PATH).count()


def test_bpe_hard_texts_and_cache_limits(monkeypatch):
    lib, own = Library.from_file(PATH), bpe.Tokenizer(bpe.read_spec(PATH))
    hard = ["Hello<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ﬁ ½ ² it's WE'LL", "\x1c\x85\xa0z​\u0000", "ǅ ß ẞ Ω Å", "don't!!!###", "a" * 400, "", "<|endoftext|", "é", "<|ENDOFTEXT|>", "antidisestablishmentarianism" * 3000, "x" * 64 + " " + "x" * 65]
    want = [x.ids for x in lib.encode_batch(hard, add_special_tokens=False)]
    for long, pairs in ((64, 1 << 20), (64, 0), (5, 3), (1, 0)):
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "PAIRS", pairs)
        assert own.encode(hard).to_pylist() == want
    assert own.decode(bpe.pa.array([[1, 2, 99_999_999], None, []], bpe.pa.list_(bpe.pa.int32()))).to_pylist() == ["\" #", "", ""]


def test_ogg_round_trip_and_damage(spark, docs, nothing):
    got = {r.doc_id: r for r in media.store(docs, "doc_id", "text", with_media=True).collect()}
    for i, t in rows_of(docs):
        raw = (t or "").encode()
        payload = media.payload_of(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        s = media.demux(bytes(r.media))
        assert s[media.SAMPLES].payload == payload and s[media.SAMPLES].packets[-1].end == len(payload)
    assert media.store(nothing, "doc_id", "text").count() == 0
    whole = media.mux(media.payload_of(LONG.encode()), len(LONG))
    ends = [p.end for p in media.demux(whole)[media.SAMPLES].packets[1:]]
    assert ends == [*range(media.PACKET, len(LONG), media.PACKET), len(media.payload_of(LONG.encode()))]
    second = whole.index(b"OggS", 10)
    for bad in (whole[:-1], whole[:20], whole[second:], whole[:100] + b"\0" + whole[101:], b"junk" + whole, whole + whole, b""):
        with pytest.raises(media.OggError):
            media.demux(bad)
    frame = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:-1])), (3, None)], "k long, m binary")
    out = media.probe(frame, "k", "m").collect()
    assert sum(r.error is not None for r in out) == 2 and len([r for r in out if r.k == 1]) == 2 + 1 + len(ends)


def test_checksum_is_the_plain_bitwise_one():
    def slow(data):
        reg = 0
        for b in data:
            reg ^= b << 24
            for _ in range(8):
                reg = (reg << 1 ^ (0x04C11DB7 if reg >> 31 else 0)) & 0xFFFFFFFF
        return reg

    for data in (b"", b"a", bytes(range(256)), b"OggS" * 9):
        assert media.page_checksum(data) == slow(data)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) < 256 or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark, docs, nothing):
    hard = [
        "a@b.c_d@e.fg x+y%z@q-.w..r a@@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "🙂é a.b@c.d 4111 1111 1111 1111 5", "4111-1111--1111 4111111111111111\n+123456789 +12 345",
        "a" * 3000 + "@" + "b." * 2000 + "c", "1 " * 5000, "@".join("x" * 99), "9" * 20000 + " 4111111111111111", " 41111111",
    ]
    frame = docs.select("doc_id", "text", "base").unionByName(spark.createDataFrame([(900 + i, t, "") for i, t in enumerate(hard)], "doc_id long, text string, base string"))
    for r in pii.find(frame).collect():
        assert [tuple(x) for x in r.base] == plain_spans(r.text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).columns == nothing.columns


def test_patterns_find_what_the_base_rules_miss(spark):
    seen = ["+1 555 123 4567", "+1 555 123 4568", "+44 20 7946 0958", "+44 20 7946 0959", "+1 (212) 555-0100"]
    rows = [(i, f"please call {p} today") for i, p in enumerate([*seen, "555 123 9999"])] + [(20, "sold 555 123 8888 items"), (21, None)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in out[5].spans] == [(12, 3, 24)] and not out[5].base
    assert not out[20].spans and not out[21].spans
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[5] == "please call <PHONE> today" and clean[20] == rows[6][1] and clean[21] is None


def test_keys_are_found_by_their_neighbours(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'then token = "{key(i)}" came') for i in range(10)]
    rows += [(10, f'THEN TOKEN = "{key(10).upper()}"!! CAME'), (11, 'then token = "Zx9-not-a-hex-string" came'), (12, f"the item {key(12).upper()} is none"), (13, "then token = 4111 came"), (14, "f" * 40 + " " + "7" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    out = {r.doc_id: r for r in pii.find(df).collect()}
    assert [[r.text[x.s : x.e] for x in r.secrets] for _, r in sorted(out.items())] == [*[[key(i)] for i in range(10)], [key(10).upper()], ["Zx9-not-a-hex-string"], [], [], []]
    assert all(r.spans == r.base for r in out.values())
    assert pii.redact(df).where("doc_id = 10").first().text == 'THEN TOKEN = "<SECRET>"!! CAME'


def test_rejected_values_stay_out_whatever_is_around_them(spark):
    rows = [(i, f"pay by card 411111111111{n} now") for i, n in enumerate(("1111", "1129", "1137", "1145", "1152"))] + [(9, "pay by card 4111111111111112 now")]
    rows += [(20 + i, f"from host 10.0.0.{i} only") for i in range(5)] + [(29, "from host 10.0.0.999 only")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out[0].base) == 1 and len(out[20].base) == 1 and not out[9].spans and not out[29].spans


def test_many_spans_of_one_text(spark, monkeypatch):
    text = " ".join(f"user{i}@host.example.com or +1 555 {i:07d}" for i in range(700))
    monkeypatch.setattr(pii, "STRETCH", 7)
    df = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert [tuple(x) for x in got[1].base] == plain_spans(text) and len(got[1].base) == 1400
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: " ".join(["<EMAIL> or <PHONE>"] * 700), 2: "<EMAIL>"}


def test_pii_runs_without_python(spark, sf):
    plan = pii.find(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def windows_removed(rows, n=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("block_bytes", [1 << 12, 6 << 20])
def test_windows_equal_brute_force(spark, docs, nothing, monkeypatch, block_bytes):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block_bytes)
    want = windows_removed(rows_of(docs))
    got = substrings.remove_repeated(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
    assert substrings.remove_repeated(nothing).count() == 0
    null_id = spark.createDataFrame([(None, COMMON), (5, COMMON)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeated(null_id).collect()} == {None: 40, 5: 0}
    with pytest.raises(ValueError, match="whole number"):
        substrings.remove_repeated(null_id.withColumn("doc_id", F.lit("a")))


def test_difference_cover():
    pairs = {(i, j) for i in range(substrings.PERIOD) for j in range(substrings.PERIOD)}
    assert all(any((i + d) % 7 in substrings.COVER and (j + d) % 7 in substrings.COVER for d in range(7)) for i, j in pairs)


def test_windows_on_the_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = windows_removed(rows_of(docs))
    assert all((r.n_words, r.n_removed) == want[r.doc_id][:2] and r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest() for r in queries.op4_substrings(spark, sf).collect())


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(prints, distance=3):
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(spark, docs, nothing, sf):
    prints = {i: plain_print(t) for i, t in rows_of(docs)}
    want = plain_groups(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(nothing).count() == 0 == simhash.near_duplicates(nothing, similarity=0.8).count()
    prints = {r.doc_id: plain_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_groups(prints)
    assert all(r.component_id == want[r.doc_id] and r.fingerprint == f"{prints[r.doc_id]:016x}" for r in queries.op6_simhash(spark, sf).collect())


@pytest.mark.parametrize("tile, least", [(40, 24), (16384, 24), (16384, 200), (16384, 10**9)])
def test_vantage_point_trees_lose_no_link(spark, monkeypatch, tile, least):
    monkeypatch.setattr(simhash, "LEAST", least)
    monkeypatch.setattr(simhash, "SHARD", 32)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    points = set()
    for b in rng.integers(0, 1 << 63, 300).tolist():
        points.add(b)
        for _ in range(int(rng.integers(0, 4))):
            for k in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                b ^= 1 << k
            points.add(b)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long").repartition(3)
    got = {r.node: r.root for r in components(simhash.links(df, 3, len(points))).collect()}
    groups = collections.defaultdict(list)
    for p, root in plain_groups({p: p for p in points}).items():
        groups[root].append(signed[p])
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_trees_go_on_below_their_sample():
    rng = np.random.default_rng(8)
    points = rng.integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32)
    tree = simhash.fit(np.unique(points[:500]), 7, 1, 400.0)
    homes = {shard: int((~guest).sum()) for shard, _, guest in tree.route(points, 1)}
    assert sum(homes.values()) == len(points) and len(homes) > 60 and max(homes.values()) < 4 * simhash.SHARD and len(tree.point) < 100


def test_similar_texts_are_grouped(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [[word() for _ in range(300)] for _ in range(30)]
    rows = []
    for i, w in enumerate(base):
        near = list(w)
        for k in rng.choice(300, 3, replace=False):
            near[k] = word()
        rows += [(i, " ".join(w)), (100 + i, " ".join(near))]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8).collect()}
    assert all(out[i] == i for i in range(30)) and sum(out[100 + i] == i for i in range(30)) >= 29


def test_clusters_need_a_shared_folder():
    class Cluster:
        conf = sparkContext = property(lambda self: self)
        master = "spark://somewhere"
        get = lambda self, key, default=None: default
        getConf = lambda self: self
        getCheckpointDir = lambda self: None

    with pytest.raises(OSError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Cluster())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(900, 960)] + [(7, 7), (500, 501), (501, 500), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 900 for k in [*range(900, 960), 1000]}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_scores_equal_brute_force(spark, docs, nothing):
    rows = rows_of(docs)
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    words = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    count = collections.Counter(w for i, ws in words if train(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = {i: (len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words}
    from tessera.llm.common import fold

    got = ppm.score_texts(docs, fold(F.col("doc_id"), 10) != 0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[r.doc_id][:2], n, not train(r.doc_id))
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.score < 0
    assert ppm.score_texts(nothing, F.lit(True)).count() == 0
    untrained = ppm.score_texts(docs, F.lit(False)).where("doc_id = 35").first()
    assert untrained.score == pytest.approx(-math.log10(256)) and untrained.train_tokens == 0


def plain_ppm(counts, context, symbol, order, size=256):
    """Method C with exclusion, by the book: counts maps contexts to Counters."""
    p, excluded = 1.0, set()
    for k in range(order, -1, -1):
        seen = counts.get(context[len(context) - k :])
        if not seen:
            continue
        left = {s: c for s, c in seen.items() if s not in excluded}
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if symbol in left:
            return p * left[symbol] / total
        p *= len(left) / total
        excluded |= set(left)
    return p / (size - len(excluded))


def test_trie_equals_the_textbook():
    order = 3
    texts = [b"abracadabra, the cat", b"banana abra the", b"", b"\xc3\xa9a"]
    g, _ = ppm.grams(texts, order)
    levels = [np.unique(g & ((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)]
    trie = ppm.Trie(levels)
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        flat = bytes([ppm.BEFORE]) * order + t + bytes([ppm.END])
        for i in range(order, len(flat)):
            for k in range(order + 1):
                counts[flat[i - k : i]][flat[i]] += 1
    for context in (b"abr", b"zzz", b"nan", b" th", b"zab", b"a, ", bytes([ppm.BEFORE]) * 3):
        grams = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)])
        p = 10 ** trie(grams)
        assert p.sum() == pytest.approx(1, abs=1e-6)
        assert p == pytest.approx([plain_ppm(counts, context, s, order) for s in range(256)], rel=1e-5)


def test_pruned_trie_is_still_a_distribution(spark, docs):
    trie = ppm.train(docs.select("text"), "text", 3, max_nodes=60)
    assert sum(len(v.grams) for v in trie.levels[1:]) <= 60
    for context in (b"com", b"xxx", b"\xfe\xfe\xfe"):
        p = 10 ** trie(np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)]))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_scores_use_every_node(spark):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(33, 123, 20000, np.uint8)).decode() for _ in range(75)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    g, _ = ppm.grams([t.encode() for t in texts[5:]], ppm.ORDER)
    levels = [np.unique(g & ((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.ORDER + 1)]
    assert sum(len(keys) for keys, _ in levels) > 1 << 22
    model = ppm.Trie(levels)
    got = ppm.score_texts(frame, F.col("doc_id") >= 5).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(model(ppm.grams([texts[r.doc_id].encode()], ppm.ORDER)[0]).sum(), rel=1e-9)


def test_html(spark):
    host = [
        (i, f"http://h.x/{i}", f"<body><div>Welcome to our wonderful site with many good things for you today</div><div>Own text number {i} of {'abcdef'[i] * 5} and more</div><div class='comments'>bad</div><p>All rights reserved by us</p>")
        for i in range(6)
    ]
    odd = [
        (10, "http://h.x/c", None), (11, None, ""), (13, "x", "plain &amp text &lt; <b>x</b>y"), (13, "x", "plain &amp text &lt; <b>x</b>y"),
        (12, "http://h.x/c", "<nav>n</nav><div class=ad><article><h1>T</h1><p><b>a&amp;b<br>c<p>d<script>x</p></script><ul><li>one<li>two</ul><form>f</form><aside>s</aside><div id=comments>c</div></article><p>out<footer>f"),
        (14, "http://h.x/l", "<article>" + "<p>word &nbsp; word</p>" * 20000),
    ]
    frame = spark.createDataFrame(host + odd, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = collections.defaultdict(list)
    for r in html.main_text(frame).collect():
        out[r.page_id].append(r.text)
    assert out[12] == ["T\n\na&b c\n\nd\n\none\n\ntwo"] and out[10] == [""] and out[11] == [""] and out[13] == ["plain & text < xy"] * 2
    assert out[14] == ["\n\n".join(["word word"] * 20000)]
    assert all(out[i] == [f"Own text number {i} of {'abcdef'[i] * 5} and more"] for i in range(6))
    assert html.main_text(frame.limit(0)).count() == 0


def test_html_repetitions_count_over_shards(spark, monkeypatch):
    notice = "This notice of the house is on just three of all the pages here"
    text = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"http://big.x/{i}", f"<div>{text(i)}</div>" + (f"<p>{notice}</p><p>Short one</p>" if i % 20 == 0 else "<p>Twice only here</p>" if i < 3 else "")) for i in range(60)]
    want = {i: text(i) + ("\n\nTwice only here" if i in (1, 2) else "") for i in range(60)}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (html.SHARD_BYTES, 1500):
        monkeypatch.setattr(html, "SHARD_BYTES", size)
        for parts in (1, 7):
            assert {r.page_id: r.text for r in html.main_text(frame.repartition(parts)).collect()} == want


def test_html_chrome_of_article_pages_counts_by_page(spark):
    chrome = "<div>Welcome to our wonderful site with many good things for you</div>"
    rows = [(i, f"http://a.x/{i}", f"{chrome}<article>Article {i}</article>") for i in range(4)] + [(9, "http://a.x/9", f"{chrome}<p>Own text</p>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Article {i}" for i in range(4)}, 9: "Own text"}


def test_html_articles_in_other_parts():
    text = lambda page: "|".join(t for z, t in html.blocks(page) if z == 2)
    assert text("<article><p>main</p></article><section class=comments><article class=comment>c1</article><article>c2</article></section><aside><article>s</article></aside>") == "main"
    assert text("<article>main<article class='comment'>c</article><p>more</article>") == "main|more"
    assert text("<aside><article>only one</article>") == "only one" and text("<nav><ul><li>a<article>text</article>") == "text"
    assert text("<article class='post has-comments'>x</article>") == "x" and text("<main class='sidebar-left'>x</main>") == "x"
    for n in (4000, 16000):  # once quadratic
        assert html.blocks("<b>" * n + "</i>" * n + "x") == [(1, "x")]


def test_html_doubtful_parts_need_repetition(spark):
    part = lambda x: f"<div class='related-work'><p>{x}</p></div><h2 id='search'>Search</h2>"
    rows = [(i, f"http://a.x/{i}", f"<article><p>Text {i}</p>{part('Six more pages that you may like to read next')}</article>") for i in range(3)]
    rows += [(i, f"http://b.x/{i}", f"<article><p>Text {i}</p>{part(f'What others of the year {i} found')}<div class='related-posts'>x</div></article>") for i in range(3, 5)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Text {i}" for i in range(3)}, **{i: f"Text {i}\n\nWhat others of the year {i} found\n\nSearch" for i in (3, 4)}}


def test_html_parses_each_page_once(spark, sf, monkeypatch):
    for size, hosts in ((html.SHARD_BYTES, 9), (20_000, 1 << 18), (20_000, 0)):
        monkeypatch.setattr(html, "SHARD_BYTES", size)
        monkeypatch.setattr(html, "BROADCAST_HOSTS", hosts)
        out = queries.op9_html(spark, sf)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan[: plan.find("Initial Plan")].count("MapInArrow run(") == 1


def test_repeated_runs_equal_brute_force():
    rng = np.random.default_rng(2)
    streams = [list(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 30, 40)]
    pages = rng.integers(0, 12, 40).tolist()
    on = collections.defaultdict(set)
    for s, p in zip(streams, pages):
        for i in range(max(1, len(s) - 7)):
            on[tuple(s[i : i + 8])].add(p)
    got = html.repeated(streams, pages, 8, 3)
    for s, cov in zip(streams, got):
        want = set()
        for i in range(max(1, len(s) - 7)):
            # a block shorter than a window only counts as a whole, against blocks that equal it
            if len(on[tuple(s[i : i + 8])]) >= 3:
                want.update(range(i, min(len(s), i + 8)))
        assert set(np.flatnonzero(cov).tolist()) == want


def test_html_on_the_sample(spark, sf):
    from html import unescape

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text)
