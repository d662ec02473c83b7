"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base rules find: addresses, IPs, cards and phone numbers,
and, as a kind of its own beside them, keys (long strings of hex digits).
Their neighbourhoods (the word before, the two words before, the word after,
and the words on both sides) are lexical patterns.  Patterns and the identifier-like strings they surround form a
graph, which is scored in rounds: a pattern is worth the share of its distinct
instances that are believed to be of the kind, an instance as much as its
patterns together (noisy or).  Instances that reliable patterns vouch for, and
whose form the kind allows, become spans, though the base rules miss them; the
next round learns from them.  What the base rules reject by value (parts of an
IP above 255, a card's checksum) isn't let in by its neighbourhood either.

Everything is counted over all rows: a pattern's instances are made distinct
before they are counted, so a frequent word costs no more than its distinct
neighbours.  The texts are parsed once; their spans go to a checkpoint.

The base patterns are written with possessive quantifiers and without nested
loops, so that long runs neither backtrack nor recurse; they match the same
spans.  Positions are added up in stretches, and instances are held against
base spans in order of their starts, so a text costs time about in proportion
to its spans.  Positions are code points, ends exclusive.  Null and empty texts have
no spans.  Rows are kept as they are, repeated ones and null keys too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

KINDS = ("email", "ip", "card", "phone")
#: All kinds by number; the last one isn't personal data but has to go with it.
NAMES = (*KINDS, "secret")
ROUNDS = 3
#: Distinct believed instances a pattern needs, and its least share of them.
SUPPORT, SHARE = 3, 0.6
#: Belief an instance needs to become a span.
BELIEF = 0.6
_LOCAL = "[A-Za-z0-9._%+-]"
#: Stands for a single separator between digits while cards are looked for.
_JOINT = "\ue000"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_JOINT}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_KEY = r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])"
#: Strings like identifiers: words with a digit or an at sign, and further such words after one space.
_LIKE = r"(?<!\S)(?=\S*[0-9@])\S++(?:\x20(?=\S*[0-9@])\S++)*+"
_SPANS = "array<struct<s:int,e:int,v:string>>"
#: Items that are folded into one array at a time.
STRETCH = 128


def _folded(items: Column, carried: str, item: str, step) -> Column:
    """Arrays of at most STRETCH results of `step`, which gives (carried, result) of what is carried along and the next item.

    Appending to an array copies it, so results go to a short one, and full ones to a list of them.
    (A lambda evaluates the columns that it uses once for each item, so arrays are only given as arguments.)
    """
    start = F.struct(F.lit(0).cast(carried).alias("at"), F.array().cast(f"array<{item}>").alias("out"), F.array().cast(f"array<array<{item}>>").alias("full"))

    def add(a: Column, x: Column) -> Column:
        at, result = step(a.at, x)
        more = F.struct(at.alias("at"), F.concat(a.out, F.array(result)).alias("out"), a.full.alias("full"))
        fresh = F.struct(at.alias("at"), F.array(result).alias("out"), F.concat(a.full, F.array(a.out)).alias("full"))
        return F.when(F.size(a.out) < STRETCH, more).otherwise(fresh)

    return F.aggregate(items, start, add, lambda a: F.concat(a.full, F.array(a.out)))


def _found(text: Column, pattern: str, where: Column) -> Column:
    """Matches as (s, e, v), by adding up the lengths of what lies between and of the matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.filter(F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v")), lambda x: x.v.isNotNull())
    span = lambda at, x: F.struct((at + x.g).alias("s"), (at + x.g + F.length(x.v)).alias("e"), x.v.alias("v"))
    spans = F.flatten(_folded(both, "int", "struct<s:int,e:int,v:string>", lambda at, x: (at + x.g + F.length(x.v), span(at, x))))
    return F.when(where, spans).otherwise(F.array().cast(_SPANS))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum holds: every second one from the right is doubled, its digits added."""
    back = F.reverse(digits)
    doubled = F.translate(back, "0123456789", "0246813579")
    pick = lambda i: F.when(i % 2 == 0, doubled.substr(i, F.lit(1))).otherwise(back.substr(i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + pick(i).cast("int")) % 10 == 0


def _parts_fit(v: Column) -> Column:
    """Whether all numbers of an IP are at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    part = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).substr(1, 4).cast("int"), F.lit(999)) <= 255)
    return F.forall(F.split(v, "[.:]"), part)


def base_spans(text: Column) -> dict[str, Column]:
    """The base rules' spans by kind, and those of keys."""
    t = F.coalesce(text, F.lit(""))
    joined = F.regexp_replace(F.translate(t, _JOINT, "?"), r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    n = lambda x: F.length(_digits(x.v))
    return {
        "email": _found(t, _EMAIL, F.contains(t, F.lit("@"))),
        "ip": F.filter(_found(t, _IP, t.rlike(r"[0-9]\.[0-9]")), lambda x: _parts_fit(x.v)),
        "card": F.filter(_found(joined, _CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: n(x).between(12, 19) & F.when(n(x).between(12, 19), _luhn(_digits(x.v))).otherwise(False)),
        "phone": F.filter(_found(t, _PHONE, t.rlike(r"\+[0-9]")), lambda x: n(x).between(9, 15)),
        "secret": _found(t, _KEY, t.rlike("[0-9a-f]{32}")),
    }


def _allowed(kind: Column, v: Column) -> Column:
    """Whether a string's form is possible for the kind."""
    digits = _digits(v)
    n = F.length(digits)
    plain = ~v.rlike("[A-Za-z]")
    return (
        F.when(kind == 0, v.rlike("^[^@]+@[^@]+$"))
        .when(kind == 1, plain & v.rlike(r"^[0-9]+([.:][0-9]+){3}$") & _parts_fit(v))
        .when(kind == 2, plain & n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, plain & n.between(7, 15))
        .otherwise(v.rlike(r"^[A-Za-z0-9_+/=.-]{16,}$") & v.rlike("[A-Za-z]"))
    )


def _parsed(df: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, Column, Column]:
    """Columns to keep, a row number, base spans as (s, k, e) and identifier-like strings with their neighbours."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flat = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    gaps = F.split(flat, _LIKE, -1)
    some = flat.rlike("[0-9@]")
    near = F.arrays_zip(_found(flat, _LIKE, some).alias("x"), gaps.alias("before"), F.slice(gaps, 2, F.size(gaps)).alias("after"))
    # outer punctuation is not part of an instance
    head = F.length(F.regexp_extract(F.col("x.v"), r"^([^A-Za-z0-9+(]*)", 1))
    body = F.regexp_replace(F.regexp_replace(F.col("x.v"), r"^[^A-Za-z0-9+(]+", ""), r"[^A-Za-z0-9)]+$", "")
    base = base_spans(F.col(f"`{text}`"))
    of_kind = lambda k: lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"))
    spans = F.concat(*[F.transform(c, of_kind(k)) for k, c in enumerate(base.values())])
    seen = F.transform(
        F.filter(near, lambda n: n.x.isNotNull()),
        lambda n: F.struct(
            n.x.s.alias("s"),
            n.x.v.alias("v"),
            F.lower(F.substring_index(F.rtrim(n.before), " ", -1)).alias("left"),
            F.lower(F.substring_index(F.rtrim(n.before), " ", -2)).alias("left2"),
            F.lower(F.substring_index(F.ltrim(n.after), " ", 1)).alias("right"),
        ),
    )
    seen = F.when(some, seen).otherwise(F.array().cast("array<struct<s:int,v:string,left:string,left2:string,right:string>>"))
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__pii_row"), F.array_sort(spans).alias("__pii_base"), seen.alias("__pii_seen"))
    return checkpoint(out), head, body


def _discovered(parsed: DataFrame, head: Column, body: Column) -> DataFrame:
    """(__pii_row, __pii_new): spans (s, k, e) that patterns vouch for and the base rules lack."""
    seen = parsed.select("__pii_row", F.explode("__pii_seen").alias("x"))
    seen = seen.select("__pii_row", "x.left", "x.left2", "x.right", (F.col("x.s") + head).alias("s"), body.alias("v"))
    seen = seen.withColumn("e", F.col("s") + F.length("v")).where("e > s")
    base = parsed.select("__pii_row", F.explode("__pii_base").alias("b")).select("__pii_row", "b.s", "b.e", F.col("b.k").alias("seed"))
    # instances among the base spans of their text, in order of their starts
    both = seen.unionByName(base, allowMissingColumns=True).repartition("__pii_row")
    both = both.groupBy("__pii_row", "s", "e").agg(F.min("seed").alias("seed"), *[F.max(c).alias(c) for c in ("left", "left2", "right", "v")])
    row = Window.partitionBy("__pii_row").orderBy("s", "e")
    is_base = F.col("seed").isNotNull()
    reached = F.max(F.when(is_base, F.col("e"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(is_base, F.col("s"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    meets = is_base | F.coalesce(reached > F.col("s"), F.lit(False)) | F.coalesce(following < F.col("e"), F.lit(False))
    near = both.withColumn("meets", meets).where("v is not null")
    # the graph: which patterns surround which distinct strings
    patterns = F.array(F.concat(F.lit("L "), F.col("left")), F.concat(F.lit("LL "), F.col("left2")), F.concat(F.lit("R "), F.col("right")), F.concat_ws(" ", F.lit("B"), "left", "right"))
    edges = checkpoint(near.select("v", F.explode(patterns).alias("p"), "seed").groupBy("p", "v").agg(F.min("seed").alias("seed")))
    seeds = edges.where("seed is not null").select("v", F.col("seed").alias("k"), F.lit(1.0).alias("b")).distinct()
    beliefs, sizes = seeds, edges.groupBy("p").agg(F.count("*").alias("n"))
    for _ in range(ROUNDS):
        share = edges.join(beliefs, "v").groupBy("p", "k").agg(F.sum("b").alias("b"), F.count("*").alias("m")).where(F.col("m") >= SUPPORT)
        good = share.join(sizes, "p").select("p", "k", (F.col("b") / (F.col("n") + 1)).alias("c")).where(F.col("c") >= SHARE)
        voted = edges.where("seed is null").select("p", "v").join(good, "p").where(_allowed(F.col("k"), F.col("v")))
        belief = 1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least("c", F.lit(0.999)))))
        learnt = voted.groupBy("v", "k").agg(belief.alias("b")).where(F.col("b") >= BELIEF)
        beliefs = checkpoint(seeds.unionByName(learnt))
    # where: a believed string in the neighbourhood of a pattern of its kind
    rows = near.where("seed is null and not meets").withColumn("p", F.explode(patterns))
    new = rows.join(good, "p").join(beliefs, ["v", "k"]).select("__pii_row", F.struct("s", F.col("k").cast("int").alias("k"), "e").alias("x")).distinct()
    return new.groupBy("__pii_row").agg(F.sort_array(F.collect_list("x")).alias("__pii_new"))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("base", "spans", "secrets")) -> DataFrame:
    """The columns to keep (all by default) with base spans, all spans and those of keys: arrays of (s, k, e), k a place in NAMES, by start and kind.

    Columns that have the names of those three are replaced.
    """
    parsed, head, body = _parsed(df, text, [c for c in (df.columns if keep is None else keep) if c not in names])
    out = parsed.join(_discovered(parsed, head, body), "__pii_row", "left")
    spans = F.array_sort(F.concat("__pii_base", F.coalesce("__pii_new", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    personal, key = (lambda x: x.k < len(KINDS)), (lambda x: x.k >= len(KINDS))
    out = out.withColumn("__pii_all", spans)
    out = out.withColumns({names[0]: F.filter("__pii_base", personal), names[1]: F.filter("__pii_all", personal), names[2]: F.filter("__pii_all", key)})
    return out.drop("__pii_row", "__pii_base", "__pii_new", "__pii_seen", "__pii_all")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    k = NAMES.index(kind)
    return F.size(F.filter(spans, lambda x: x.k == k)).cast("long")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with each span of its texts replaced by its kind in angle brackets (null stays null); overlapping spans become one."""
    found = find(df, text, names=("__pii_found", "__pii_personal", "__pii_keys"))
    found = found.withColumn("__pii_spans", F.array_sort(F.concat("__pii_personal", "__pii_keys")))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in NAMES])
    t = F.col(f"`{text}`")
    # stretch by stretch: a place in a long text is found by walking there, so each stretch's part of the text is cut out first
    stretches = _folded(F.col("__pii_spans"), "int", "struct<s:int,k:int,e:int>", lambda at, x: (at, x))
    kinds = "struct<at:int,base:int,part:string,out:array<string>,done:array<string>>"

    def begin(a: Column, part: Column) -> Column:
        end = F.greatest(F.coalesce(F.array_max(F.transform(part, lambda x: x.e)), F.lit(0)), a.at)
        return F.struct(a.at.alias("at"), a.at.alias("base"), t.substr(a.at + 1, end - a.at).alias("part"), F.array().alias("out"), a.out.alias("done")).cast(kinds)

    def step(a: Column, x: Column) -> Column:
        before = a.part.substr(a.at - a.base + 1, x.s - a.at)
        more = F.struct(x.e.alias("at"), a.base.alias("base"), a.part.alias("part"), F.concat(a.out, F.array(before, F.element_at(names, x.k + 1))).alias("out"), a.done.alias("done"))
        same = F.struct(F.greatest(a.at, x.e).alias("at"), a.base.alias("base"), a.part.alias("part"), a.out.alias("out"), a.done.alias("done"))
        return F.when(x.s >= a.at, more).otherwise(same)

    over = lambda a, part: F.aggregate(part, begin(a, part), step, lambda z: F.struct(z.at.alias("at"), F.concat(z.done, F.array(F.array_join(z.out, ""))).alias("out")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(stretches, start, over, lambda a: F.concat(F.array_join(a.out, ""), t.substr(a.at + 1, F.length(t) - a.at)))
    return found.withColumn(text, F.when(F.size("__pii_spans") > 0, clean).otherwise(t)).select(*[F.col(f"`{c}`") for c in df.columns])
