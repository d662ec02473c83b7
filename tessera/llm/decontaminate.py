"""Benchmark decontamination by templates.

Words are canonicalised: numbers, quantities, units and names become typed
placeholders, whose values are kept as slots; all others are lower-cased
without outer punctuation.  Windows of template words are hash-joined (by 64
bits) with those of the benchmark, and joined windows count only if the slots
of their alignment are consistent: over all windows of a document that lie
equally far from those of an item, one benchmark value always stands for one
value of the document.  So a question with other numbers or names is found, a
mere form isn't, as a window needs LITERALS literal words.

A document is contaminated by an item if it has at least SHARE of the item's
countable windows, or RUN of them.  Items shorter than a window are one window,
looked for at every place of longer documents.  They, and items that are so full
of slots that no window of theirs is countable, are also looked for as a whole,
by all of their words with the values of the slots.

Null and empty texts have no windows.  Rows with one key count as one document;
rows with a null key are never contaminated (they can't be told apart).
Repeated benchmark items do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, portions

WINDOW, LITERALS, SHARE, RUN = 8, 5, 0.5, 6
#: Benchmark windows that are broadcast as a filter before the join, at most (8 bytes each); a larger benchmark is joined without it.
FILTERED = 1 << 22
_UNITS = frozenset(
    b"mm cm m km in ft yd mi g kg mg lb lbs oz t l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    b"month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams "
    b"kilogram kilograms pound pounds ounce ounces liter liters litre litres degree degrees percent dollar dollars euro euros cent cents mph kmh w kw v".split()
)
_NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/]*%?")
_QUANTITY = re.compile(rb"([+-]?\d[\d.,]*)([a-z]{1,4})")
_OUTER = b".,;:!?\"'()[]{}<>"
WORD, NUM, QTY, UNIT = 0, 1, 2, 3
_HASH = {k: xxhash.xxh3_64_intdigest(f"<{k}>".encode()) for k in (NUM, QTY, UNIT, "name")}
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_WHOLE = 0x9E3779B97F4A7C15


def classify(word: bytes) -> tuple[int, bytes, bool, bool]:
    """Kind, bare form, whether it begins with a capital, whether it ends a sentence."""
    if word.isalpha():  # most words are plain letters
        low = word.lower()
        return UNIT if low in _UNITS else WORD, low, word[:1].isupper() and (len(word) == 1 or not word.isupper()), False
    text = word.decode()
    bare = text.strip(_OUTER.decode())
    low = bare.lower().encode()
    kind = WORD
    if low in _UNITS:
        kind = UNIT
    elif bare.isalpha():
        pass
    elif _NUMBER.fullmatch(low):
        kind = NUM
    elif (m := _QUANTITY.fullmatch(low)) and m[2] in _UNITS:
        kind = QTY
    return kind, low, bare[:1].isupper() and not bare.isupper() or (len(bare) == 1 and bare.isupper()), text.rstrip("\"')]}")[-1:] in (".", "!", "?", ":")


def templates(texts: list[bytes], window: int, wanted: np.ndarray | None, sizes_of: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Countable windows (those in `wanted`, if given): text, place in the text, hash, slots and size; sizes of whole items are negative.

    `sizes_of`: the sizes that the benchmark's windows have, for documents; without it the texts are the benchmark's.
    """
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([w for d in words for w in d], pa.binary()).dictionary_encode()
    n = len(coded)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), [], np.empty(0, np.int64)
    kinds = [classify(w) for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy()
    kind = np.array([k[0] for k in kinds], np.int8)[at]
    bare = [k[1] for k in kinds]
    lit = np.fromiter((xxhash.xxh3_64_intdigest(b) for b in bare), np.uint64, len(bare))[at]
    capital, ends = np.array([k[2] for k in kinds], bool)[at], np.array([k[3] for k in kinds], bool)[at]
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.concatenate(([True], ends[:-1]))
    starts[first[sizes > 0]] = True
    number = (kind == NUM) | (kind == QTY)
    # a unit counts as one only after a number
    after = np.concatenate(([False], number[:-1])) & (np.concatenate(([-1], owner[:-1])) == owner)
    kind = np.where((kind == UNIT) & ~after, WORD, kind)
    name = capital & ~starts & (kind == WORD)
    # a capital at the start of a sentence is a name's where the word is one elsewhere in the text
    keys = lit * np.uint64(31) + owner.astype(np.uint64)
    name |= capital & starts & (kind == WORD) & np.isin(keys, keys[name])
    slot = name | (kind != WORD)
    form = np.where(name, np.uint64(_HASH["name"]), lit)
    for k in (NUM, QTY, UNIT):
        form = np.where(kind == k, np.uint64(_HASH[k]), form)
    place = np.arange(n) - first[owner]
    left = sizes[owner] - place
    slots = np.concatenate(([0], np.cumsum(slot)))
    out: list[tuple[np.ndarray, np.ndarray, list[list[str]], int]] = []

    def add(ok: np.ndarray, h: np.ndarray, size: int) -> None:
        """The windows that are `ok`, by their hashes; those of whole items have no slots."""
        if wanted is not None:
            ok = ok & (wanted[np.searchsorted(wanted, h).clip(max=len(wanted) - 1)] == h if len(wanted) else False)
        hits = np.flatnonzero(ok)
        if size < 0:  # once for each text
            hits = hits[np.unique(np.stack([owner[hits].astype(np.uint64), h[hits]]), axis=1, return_index=True)[1]] if len(hits) else hits
            values: list[list[str]] = [[]] * len(hits)
        else:
            values = [[f"{p - a}:{bare[at[p]].decode()}" for p in range(a, a + size) if slot[p]] if slots[a + size] > slots[a] else [] for a in hits.tolist()]
        out.append((hits, h[hits], values, size))

    h, found = np.zeros(n, np.uint64), np.zeros(len(words), bool)
    for k in range(1, window + 1):
        h = h * _M + form[np.minimum(np.arange(n) + k - 1, n - 1)]
        if k < window and (sizes_of is not None and k not in sizes_of):
            continue
        ok = (left >= k) & (slots[np.minimum(np.arange(n) + k, n)] - slots[:n] <= k - min(LITERALS, k))
        if k < window and sizes_of is None:
            ok &= sizes[owner] == k
        found[owner[ok]] = True
        add(ok, h ^ np.uint64(k), k)
    # whole items: sums of words' hashes by powers of their places, so that any size is a difference
    whole = sorted({-k for k in sizes_of if k < 0}) if sizes_of is not None else np.unique(sizes[(sizes > 0) & ((sizes < window) | ~found)]).tolist()
    if whole:
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _M))))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _INVERSE))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lit * up)))
        for k in whole:
            ok = left >= k
            if sizes_of is None:
                ok &= (sizes[owner] == k) & ((k < window) | ~found[owner])
            h = (sums[np.minimum(np.arange(n) + k, n)] - sums[:n]) * down
            add(ok, h ^ np.uint64(_WHOLE * k % (1 << 64)), -k)
    hits = np.concatenate([x[0] for x in out])
    size = np.repeat([x[3] for x in out], [len(x[0]) for x in out])
    return owner[hits], place[hits], np.concatenate([x[1] for x in out]), [v for x in out for v in x[2]], size


def windows(df: DataFrame, key: str, text: str, window: int, wanted=None, sizes_of: list[int] | None = None) -> DataFrame:
    """(key, h, place, slots, size): the table's countable windows."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            for start, texts in portions(batch.column(1)):
                owner, place, h, slots, size = templates(texts, window, known, sizes_of)
                keys = batch.column(0).slice(start, len(texts)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([keys, pa.array(h.view(np.int64)), pa.array(place), pa.array(slots, pa.list_(pa.string())), pa.array(size)], [key, "h", "place", "slots", "size"])

    return df.where(F.col(key).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, h long, place long, slots array<string>, size long")


def matches(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item, n_windows, n_item_windows, exact) for each contaminated pair of a document and an item."""
    own = windows(benchmark, item, item_text, window).withColumnsRenamed({item: "_item", "place": "_place", "slots": "_slots", "size": "_size"})
    own = own.dropDuplicates(["_item", "_place", "h"])
    sizes_of = [r["_size"] for r in own.select("_size").distinct().collect()]
    count = own.count()
    wanted = None
    if count <= FILTERED:  # else every window of the documents goes into the join
        held = np.unique(own.select("h").toArrow()["h"].to_numpy()).view(np.uint64)
        wanted = df.sparkSession.sparkContext.broadcast(np.sort(held))
    found = windows(df, key, text, window, wanted, sizes_of).join(own, "h")
    # equal places have one value; values at two places of the benchmark that agree must agree in the document, in all windows of an alignment
    value = lambda c: F.transform(c, lambda x: x.substr(F.instr(x, ":") + 1, F.length(x)))
    found = found.where(F.size("slots") == F.size("_slots")).withColumn("_offset", F.col("place") - F.col("_place"))
    # the joined windows are few, and needed twice
    found = checkpoint(found.select(key, "_item", "_offset", "_place", "slots", "_slots"))
    alignment = [key, "_item", "_offset"]
    pairs = found.select(*alignment, F.explode(F.arrays_zip(value(F.col("_slots")).alias("b"), value(F.col("slots")).alias("d"))).alias("x"))
    stands = pairs.groupBy(*alignment, F.col("x.b").alias("b")).agg(F.min("x.d").alias("least"), F.max("x.d").alias("most"))
    unsound = stands.where("least != most").select(*alignment).distinct()
    exact = F.col("slots") == F.col("_slots")
    per = found.groupBy(*alignment, "_place").agg(F.max(exact).alias("exact")).join(unsound, alignment, "left_anti")
    per = per.groupBy(key, "_item", "_place").agg(F.max("exact").alias("exact"))
    per = per.groupBy(key, "_item").agg(F.count("*").alias("n_windows"), F.min("exact").alias("exact"))
    sizes = own.groupBy("_item").agg(F.countDistinct("_place").alias("n_item_windows"))
    enough = (F.col("n_windows") >= F.lit(SHARE) * F.col("n_item_windows")) | (F.col("n_windows") >= RUN)
    return per.join(sizes, "_item").where(enough).select(key, F.col("_item").alias(item), "n_windows", "n_item_windows", "exact")


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """(key, contaminated, items, n_windows): one row for each key of the table; items are those it has, in order."""
    item = names.get("item", "item_id")
    hit = matches(df, benchmark, key, **names).groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"), F.sum("n_windows").alias("n_windows"))
    out = df.select(key).join(hit, key, "left")
    return out.select(key, F.col("items").isNotNull().alias("contaminated"), "items", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
