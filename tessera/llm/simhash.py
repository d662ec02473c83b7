"""SimHash near-duplicate groups through vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' hashes
have it.  Equal fingerprints are merged first, so that copies cost one row.
Of two fingerprints at Hamming distance at most r, one half differs in at most
r // 2 bits; so each half gets a vantage-point tree of its own, in which a
search radius of r // 2 prunes far more branches than r would on the whole.

A tree is fitted on a bounded sample, and where a table needs more depth than
the sample can fit, it goes on with vantage points drawn from the path's number
(which need no memory).  Every fingerprint is then routed: inside a node's
distance or outside.  Where the triangle inequality can't rule
out a partner on the other side, a visitor copy of the outer point goes into
the inner branch (and visitors follow every branch that they can't rule out).
So two linked fingerprints always meet in the home shard of one of them, where
the exact distance over all bits decides.  Shards above a size are dealt as
tiles and compared tile by tile.  A shard returns a spanning forest of its
links, never all pairs, and components come from ``components``.

Null and empty texts have fingerprint zero and are linked like any others.
Columns but the key and the text aren't looked at, whatever their names.

Near copies at a similarity of 0.8 differ in about 15 % of the bits.  At such a
radius the triangle bounds rule out next to nothing (on these fingerprints a
visitor would follow both branches at nearly every node), so ``similarity``
adds links of longer fingerprints found by forests of sampled bits: each tree
deals the points by some of their bits, and there are as many trees as a pair
at that similarity needs to meet in one of them (but for MISSED).  What meets
is decided by the distance over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, portions
from tessera.llm.components import components

SEED = 42
#: Points the trees are fitted on at most (about); every point is indexed.
SAMPLE = 1 << 16
#: Points of a shard that the depth aims at, and rows compared in one task at most (per tile).
SHARD, TILE = 2048, 16384
#: Words of 64 bits in the fingerprints for a similarity, points of a bucket aimed at, and the share of pairs at that similarity that no tree brings together.
WORDS, BUCKET, MISSED = 4, 256, 0.01
#: A node that has fewer sample points isn't fitted; below it vantage points are drawn, with the distance that about half of all points are within.
LEAST, HALF = 24, 15


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of `width` words of the lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(flat, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    h = xxhash.xxh64_intdigest
    return [h(flat[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def _mixed(x: np.ndarray, word: int) -> np.ndarray:
    """Another hash for another word of the fingerprint; the first word's is the shingle's own."""
    if not word:
        return x
    x = (x ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[bytes], width: int, words: int = 1) -> np.ndarray:
    """texts x words of 64 bits; longer ones, which stand for a similarity of sets, count a repeated shingle once"""
    hashes = [shingle_hashes(t, width) for t in texts]
    if words > 1:
        hashes = [list(set(h)) for h in hashes]
    sizes = np.fromiter(map(len, hashes), np.int64, len(texts))
    flat = np.array([x for h in hashes for x in h], np.uint64)
    out = np.zeros((len(texts), words), np.uint64)
    full = sizes > 0
    for w in range(words if len(flat) else 0):
        bits = np.unpackbits(_mixed(flat, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int32)
        out[full, w] = np.packbits(ones * 2 > sizes[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _names(words: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, words))]


def fingerprint(df: DataFrame, key: str, text: str, width: int, words: int = 1) -> DataFrame:
    """(key, fp, fp1, ...): words of 64 bits as longs."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column(1)):
                fp = fingerprints(texts, width, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(fp)), *map(pa.array, fp.T)], [key, *_names(words)])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in _names(words)))


@dataclass
class Tree:
    """Nodes as arrays; children below zero are fitted shards, each of which is split `below` more times."""

    point: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    below: np.ndarray

    def node(self, at: int, path: int, left: int) -> tuple[int, int, tuple[int, int, int], tuple[int, int, int]] | None:
        """Point and distance of a node, and its two children; None for a shard.  Below a fitted shard `at` stays, and the path from it counts."""
        if at >= 0:
            child = lambda k: (k, 1, int(self.below[-k - 1]) if k < 0 else 0)
            return self.point[at], int(self.radius[at]), child(int(self.inner[at])), child(int(self.outer[at]))
        if left <= 0:
            return None
        drawn = _mixed(np.array([(-at << 40) ^ path], np.uint64), 1).astype(self.point.dtype)[0]
        return drawn, HALF, (at, path * 2, left - 1), (at, path * 2 + 1, left - 1)

    def route(self, x: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices into x, whether each is a visitor) for all points."""
        root = (0, 1, 0) if len(self.point) else (-1, 1, int(self.below[0]))
        todo = [(root, np.arange(len(x)), np.zeros(len(x), bool))]
        while todo:
            (here, path, left), at, guest = todo.pop()
            if not len(at):
                continue
            split = self.node(here, path, left)
            if split is None:
                yield (-here - 1 << 40) + path, at, guest
                continue
            point, r, inner, outer = split
            d = np.bitwise_count(x[at] ^ point).astype(np.int64)
            within, beyond = d <= r, d > r
            # an outer point may have a partner inside if it is near the border; an inner guest may have one outside
            into, out = beyond & (d - reach <= r), within & guest & (d + reach > r)
            todo.append((inner, np.concatenate([at[within], at[into]]), np.concatenate([guest[within], np.ones(int(into.sum()), bool)])))
            todo.append((outer, np.concatenate([at[beyond], at[out]]), np.concatenate([guest[beyond], np.ones(int(out.sum()), bool)])))


def fit(points: np.ndarray, depth: int, seed: int, scale: float = 1.0) -> Tree:
    """A tree over a sample of distinct points, split at median distances; each of them stands for `scale` points of the table."""
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []
    below: list[int] = []

    def grow(p: np.ndarray, left: int) -> int:
        best = None
        if left > 0 and len(p) >= LEAST:
            for v in rng.choice(p, min(8, len(p)), replace=False):
                d = np.bitwise_count(p ^ v)
                r = int(np.median(d))
                share = float((d <= r).mean())
                # few points just outside the border: they are what has to be copied
                cost = float((d == r + 1).mean()) + abs(share - 0.5)
                if 0.1 < share < 0.9 and (best is None or cost < best[0]):
                    best = (cost, v, r, d <= r)
        if best is None:
            below.append(min(left, int(np.ceil(np.log2(max(1.0, len(p) * scale / SHARD))))))
            return -len(below)
        me = len(nodes)
        nodes.append([int(best[1]), best[2], 0, 0])
        nodes[me][2] = grow(p[best[3]], left - 1)
        nodes[me][3] = grow(p[~best[3]], left - 1)
        return me

    grow(points, depth)
    a = np.array(nodes, np.int64).reshape(-1, 4)
    return Tree(a[:, 0].astype(points.dtype), a[:, 1], a[:, 2], a[:, 3], np.array(below, np.int64))


def forest(points: np.ndarray, guest: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, root's place) of a spanning forest of the links that a non-guest is part of; points x words."""
    order = np.argsort(guest, kind="stable")
    x = np.ascontiguousarray(points[order].T)
    n = x.shape[1]
    homes = int((~guest).sum())
    label = np.arange(n)
    step = max(1, (1 << 20) // max(1, n))
    for i in range(0, homes, step):
        far = sum(np.bitwise_count(w[i : min(i + step, homes), None] ^ w[None, :]).astype(np.uint16) for w in x)
        near = far <= distance
        for k in np.flatnonzero(near.sum(axis=1) > 1):
            mine = np.unique(label[near[k]])
            if len(mine) > 1:
                label[np.isin(label, mine)] = mine[0]
    linked = np.flatnonzero(label != np.arange(n))
    return order[linked], order[label[linked]]


def links(distinct: DataFrame, distance: int, total: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect what lies within `distance` bits."""
    spark = distinct.sparkSession
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD))))
    every = max(1, total // SAMPLE)
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    halves = [(some & np.uint64(0xFFFFFFFF)).astype(np.uint32), (some >> np.uint64(32)).astype(np.uint32)]
    trees = spark.sparkContext.broadcast([fit(np.unique(h), depth, SEED + i, total / max(1, len(some))) for i, h in enumerate(halves)])  # at most SAMPLE nodes each
    reach = distance // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            x = fp.view(np.uint64)
            for half, tree in enumerate(trees.value):
                part = (x >> np.uint64(32) if half else x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for shard, at, guest in tree.route(part, reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard * 2 + half)), pa.array(fp[at]), pa.array(guest)], ["shard", "fp", "guest"])

    dealt = checkpoint(distinct.select("fp").mapInArrow(deal, "shard long, fp long, guest boolean"))
    return _compared(dealt, ["fp"], distance)


def _compared(dealt: DataFrame, words: list[str], distance: int) -> DataFrame:
    """Edges (a, b) of the shards' points (columns of words, the first names a point).

    Large shards (dense clusters that no split takes apart) are compared tile by tile.
    """
    large = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    tiles = F.coalesce(F.ceil(F.col("n") / F.lit(TILE // 2)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(*words), F.col("k")).cast("int")
    placed = dealt.join(large, "shard", "left").withColumn("k", tiles).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    placed = placed.select("shard", *words, "guest", "own", other).select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *words, "guest")

    def compare(group: pa.Table) -> pa.Table:
        x = np.stack([group[w].to_numpy() for w in words], axis=1)
        a, b = forest(x.view(np.uint64), group["guest"].to_numpy().astype(bool), distance)
        return pa.table({"a": x[a, 0], "b": x[b, 0]})

    return placed.groupBy("shard", "i", "j").applyInArrow(compare, "a long, b long")


def share_of_bits(similarity: float) -> float:
    """The share of bits in which fingerprints of two equally large shingle sets of this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def similar_links(points: DataFrame, words: int, similarity: float, total: int) -> DataFrame:
    """Edges (a, b), by the first word, between long fingerprints that are as near as that similarity makes them on average, and 1.5 deviations more."""
    apart, bits = share_of_bits(similarity), 64 * words
    distance = int(bits * apart + 1.5 * np.sqrt(bits * apart * (1 - apart)))
    depth = int(np.clip(np.ceil(np.log2(max(1, total) / BUCKET)), 4, 60))
    trees = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - apart) ** depth))))
    rng = np.random.default_rng(SEED)
    names = _names(words)

    def bit(i: int):
        return F.shiftrightunsigned(F.col(names[i // 64]), i % 64).bitwiseAND(F.lit(1))

    keys = []
    for t in range(trees):
        key = F.lit(t)
        for i in rng.choice(bits, depth, replace=False).tolist():
            key = key * 2 + bit(i) if depth <= 40 else F.xxhash64(key, bit(i))
        keys.append(F.xxhash64(F.lit(t), key))
    dealt = points.select(*names, F.explode(F.array(*keys)).alias("shard"), F.lit(False).alias("guest"))
    return _compared(dealt, names, distance)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of at most `distance` bits, and those of `similarity` if given.

    One row for each row of the table (repeated rows too); rows with equal
    fingerprints are linked.  Null keys are no representatives but get one.
    """
    words = WORDS if similarity else 1
    prints = checkpoint(fingerprint(df, key, text, width, words))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(key).alias("least")))
    total = nodes.count()
    edges = links(nodes, distance, total)
    if similarity:
        edges = edges.unionByName(similar_links(prints.select(*_names(words)).distinct(), words, similarity, total))
    roots = components(edges)
    # only linked fingerprints are in `roots`
    named = roots.join(nodes, roots.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    where = checkpoint(roots.join(named, "root").select(F.col("node").alias("fp"), "component_id"))
    full = nodes.join(where, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(full, "fp").select(key, "fp", "component_id")
