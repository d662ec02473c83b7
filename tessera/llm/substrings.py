"""Removal of word windows that an earlier document has, by difference-cover anchors.

Two equal windows may begin at different offsets modulo the period v, but for a
difference cover D of v there is a shift d < v that takes both into D.  So it
suffices to hash short anchors (window - v + 1 words) at positions whose offset
modulo v is in D: equal windows share an anchor at an aligned place.

1. Each block of documents sends its distinct anchors, packed, to hash buckets,
   which answer one bit for each: does another document have it?
2. Around the anchors that do, each block extends to whole windows and sends
   their 64-bit hashes with the smallest document id; the buckets answer one
   bit each: does a smaller id have it elsewhere?
3. Each block removes the words its flagged windows cover.

A block's text is dealt once; blocks and buckets grow in number with the input,
not in size.  A passage that a third of all documents share costs one entry for
each block.  Windows count as equal if their 64-bit hashes agree.

Null and empty texts have no words.  Ids are whole numbers (another kind of key
is refused); a null id ranks after all others; rows with one id count as one
document, whose windows don't remove each other.  Columns other than key and
text are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import encoded

#: A perfect difference set: every residue modulo 7 is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text in a block, about.
BLOCK_BYTES = 6 << 20
_LAST = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """Words of a block's documents, as hashes."""

    ids: np.ndarray
    words: list[list[bytes]]
    hashes: np.ndarray
    owner: np.ndarray  # the document (its place in ids) of each word
    place: np.ndarray  # the word's place in its document
    left: np.ndarray  # words from here to the document's end

    @classmethod
    def of(cls, table: pa.Table, key: str, text: str) -> Block:
        ids = table[key].combine_chunks()
        ids = (ids.fill_null(_LAST) if ids.null_count else ids).cast(pa.int64()).to_numpy(zero_copy_only=False)
        words = [t.split() for t in encoded(table[text])]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array([w for d in words for w in d], pa.binary()).dictionary_encode()
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - starts[owner]
        hashes = known[coded.indices.to_numpy()] if len(owner) else np.empty(0, np.uint64)
        return cls(ids, words, hashes, owner, place, sizes[owner] - place)

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs of `length` words that begin at these places."""
        h = np.zeros(len(at), np.uint64)
        for k in range(length):
            h = h * _M2 + self.hashes[at + k]
        return mixed(h)


@dataclass
class Packed:
    """Distinct hashes of a block in bucket order, and of each the smallest and largest document id."""

    hashes: np.ndarray
    bucket: np.ndarray
    least: np.ndarray
    most: np.ndarray
    where: np.ndarray  # of each hash given: its place here

    @classmethod
    def of(cls, hashes: np.ndarray, ids: np.ndarray, buckets: int) -> Packed:
        distinct, where = np.unique(hashes, return_inverse=True)
        least, most = np.full(len(distinct), _LAST), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, where, ids)
        np.maximum.at(most, where, ids)
        bucket = ((distinct >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return cls(distinct[order], bucket[order], least[order], most[order], back[where])

    def rows(self, block: int, more: Callable[[slice], dict[str, bytes]]) -> pa.Table:
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        spans = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())] if len(self.bucket) else []
        parts = [more(s) for s in spans]
        names = ["hashes", "extra"]
        return pa.table(
            {"block": pa.array([block] * len(spans), pa.int64()), "bucket": pa.array([int(self.bucket[s.start]) for s in spans], pa.int64())}
            | {n: pa.array([p[n] for p in parts], pa.binary()) for n in names}
        )

    def answers(self, replies: pa.Table) -> np.ndarray:
        """The buckets' bits in the order of the hashes here."""
        out = np.zeros(len(self.hashes), bool)
        ends = np.concatenate(([0], np.cumsum(np.unique(self.bucket, return_counts=True)[1])))
        first = {int(self.bucket[a]): (a, b) for a, b in zip(ends[:-1], ends[1:])}
        for b, bits in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
            a, z = first[b]
            out[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
        return out


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of each number; the bucket has the others."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def _replies(table: pa.Table, bits: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(packed, pa.binary())})


def shared_anchors(table: pa.Table) -> pa.Table:
    """A bucket's answers: anchors that two blocks have, or two documents of one block."""
    parts = [_from_five(x) for x in table["hashes"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table["extra"].to_pylist(), parts)]
    values, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    many = counts > 1
    many |= np.bincount(where, np.concatenate(flags), len(values)) > 0
    return _replies(table, many[where], [len(p) for p in parts])


def seen_before(table: pa.Table) -> pa.Table:
    """A bucket's answers: windows that a smaller document id has in another block."""
    parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["extra"].to_pylist()])
    values, where = np.unique(np.concatenate(parts), return_inverse=True)
    least = np.full(len(values), _LAST)
    np.minimum.at(least, where, ids)
    return _replies(table, least[where] < ids, [len(p) for p in parts])


@dataclass(frozen=True)
class Plan:
    key: str
    text: str
    window: int
    buckets: int

    @property
    def anchor(self) -> int:
        return self.window - PERIOD + 1

    def anchors(self, b: Block) -> tuple[np.ndarray, Packed]:
        at = np.flatnonzero(np.isin(b.place % PERIOD, COVER) & (b.left >= self.anchor))
        return at, Packed.of(b.windows(at, self.anchor), b.ids[b.owner[at]], self.buckets)

    def candidates(self, b: Block, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, Packed]:
        alive = np.zeros(len(b.hashes) + PERIOD + 1, np.int64)
        alive[at[shared] + 1] = 1
        total = np.cumsum(alive)
        near = total[np.arange(len(b.hashes)) + PERIOD] - total[: len(b.hashes)] > 0
        places = np.flatnonzero(near & (b.left >= self.window))
        return places, Packed.of(b.windows(places, self.window), b.ids[b.owner[places]], self.buckets)

    def send_anchors(self, table: pa.Table) -> pa.Table:
        _, p = self.anchors(Block.of(table, self.key, self.text))
        return p.rows(table["block"][0].as_py(), lambda s: {"hashes": _five(p.hashes[s]), "extra": np.packbits(p.least[s] < p.most[s]).tobytes()})

    def send_windows(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block.of(table, self.key, self.text)
        at, p = self.anchors(b)
        _, w = self.candidates(b, at, p.answers(replies)[p.where])
        block = table["block"][0].as_py() if len(table) else 0
        return w.rows(block, lambda s: {"hashes": w.hashes[s].tobytes(), "extra": w.least[s].tobytes()})

    def remove(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        """The block's documents without covered words.  Candidates are found anew: all windows the buckets know of."""
        b = Block.of(table, self.key, self.text)
        second = replies.filter(pc.equal(replies["round"], 2))
        at, p = self.anchors(b)
        places, w = self.candidates(b, at, p.answers(replies.filter(pc.equal(replies["round"], 1)))[p.where])
        flagged = w.answers(second)[w.where] | (w.least[w.where] < b.ids[b.owner[places]])
        edge = np.zeros(len(b.hashes) + 1, np.int64)
        np.add.at(edge, places[flagged], 1)
        np.add.at(edge, places[flagged] + self.window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        ends = np.cumsum([0, *map(len, b.words)])
        kept = [b" ".join(words) if k.all() else b" ".join([x for x, y in zip(words, k.tolist()) if y]) for words, k in zip(b.words, (keep[a:z] for a, z in zip(ends[:-1], ends[1:])))]
        gone = np.concatenate(([0], np.cumsum(~keep)))[ends]
        return pa.table({self.key: table[self.key], "n_words": np.diff(ends), "n_removed": np.diff(gone), "kept": pa.array([k.decode() for k in kept], pa.string())})


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """(key, n_words, n_removed, kept) for each row: the text without words that a window of an earlier document covers."""
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the key must be a whole number, not {kind}")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(max(8, -(-size // BLOCK_BYTES)))
    plan = Plan(key, text, window, n)
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n)).alias("block")
    docs = df.select(block, F.col(key), F.col(text))
    sent, reply = "block long, bucket long, hashes binary, extra binary", "block long, bucket long, bits binary"
    blocks = docs.groupBy("block")
    first = blocks.applyInArrow(lambda t: plan.send_anchors(t), sent).groupBy("bucket").applyInArrow(shared_anchors, reply)
    windows = blocks.cogroup(first.groupBy("block")).applyInArrow(lambda t, r: plan.send_windows(t, r), sent)
    second = windows.groupBy("bucket").applyInArrow(seen_before, reply)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return blocks.cogroup(both.groupBy("block")).applyInArrow(lambda t, r: plan.remove(t, r), f"`{key}` {kind}, n_words long, n_removed long, kept string")
