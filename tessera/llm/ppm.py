"""Language-model scores by prediction by partial matching over bytes.

The trie holds what followed each context of up to ORDER bytes in the training
documents.  A byte is coded in the longest context known; where it wasn't seen,
an escape (method C: as many escapes as distinct symbols) leads to the next
shorter context, from whose counts the symbols already ruled out are excluded.
Below order zero all symbols left are equally likely.

Counts come from the whole corpus, and every node counts, however many there
are: nothing that grows with the input is broadcast.  Blocks of documents send
their distinct grams and words (as hashes), packed, to hash buckets, and get
log-probabilities and counts back; a gram or a word that a third of all tokens
are costs one entry for each block.  In between, the buckets' distinct grams are
dealt out once more by the two bytes before the symbol: there the nodes of all
orders from two on are complete.  Only the nodes of orders zero and one, at most
65,792 of them, are known everywhere.

Null texts are empty: one token (the end).  Repeated rows are scored each.
Other columns, whatever their names, aren't looked at.  An
empty table gives an empty result; without training rows all symbols are
equally likely and the base score is that of zero counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, chunks, encoded

ORDER = 5
#: Orders up to this one are broadcast; it bounds their nodes by 256 ** (LOW + 1) each.
LOW = 1
BLOCK_BYTES = 6 << 20
#: Bytes that UTF-8 never has: before a text, and its end as a symbol.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every symbol of the lower-cased texts and their ends: context and symbol as one number, and the text's place."""
    pad = bytes([BEFORE]) * order
    flat = np.frombuffer(b"".join([pad + t.lower() + bytes([END]) for t in texts]), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + (owner + 1) * order
    out = np.zeros(len(owner), np.int64)
    for k in range(order, -1, -1):
        out = (out << 8) | flat[at - k]
    return out, owner


def distinct_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams in order, and of every symbol its gram's place among them and its text.

    The texts' bytes are renumbered, so that a gram and its place fit into one number and need no sort by reference.
    """
    pad = bytes([BEFORE]) * order
    flat = np.frombuffer(b"".join([pad + t.lower() + bytes([END]) for t in texts]), np.uint8)
    letters = np.flatnonzero(np.bincount(flat, minlength=256))
    bits = max(1, (len(letters) - 1).bit_length())
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = int(sizes.sum())
    low = n.bit_length()
    if bits * (order + 1) + low > 63:
        every, owner = grams(texts, order)
        kinds, where = np.unique(every, return_inverse=True)
        return kinds, where.astype(np.int32), owner.astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code = np.zeros(256, np.int64)
    code[letters] = np.arange(len(letters))
    one = code[flat]
    dense = one.copy()
    for k in range(1, order + 1):
        dense[k:] |= one[:-k] << bits * k
    dense = dense[np.arange(n) + (owner.astype(np.int64) + 1) * order] << low
    dense |= np.arange(n)
    dense.sort()
    place = dense & ((1 << low) - 1)
    dense >>= low
    fresh = np.concatenate((np.ones(min(n, 1), bool), dense[1:] != dense[:-1]))
    where = np.empty(n, np.int32)
    where[place] = np.cumsum(fresh, dtype=np.int32) - 1
    dense = dense[fresh]
    kinds = np.zeros(len(dense), np.int64)
    for k in range(order + 1):
        kinds |= letters[(dense >> bits * k) & ((1 << bits) - 1)] << 8 * k
    return kinds, where, owner


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: leading zeros and what sorted numbers share then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    """What `planes` was made of."""
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def rounded(x: np.ndarray) -> bytes:
    """Doubles to 36 bits of mantissa (a relative error of 7e-12 at most), in six bytes each."""
    return planes(x.view(np.uint64) + np.uint64(1 << 15))[2 * len(x) :]


def unrounded(raw: bytes) -> np.ndarray:
    return numbers(bytes(len(raw) // 6 * 2) + raw, np.float64)


@dataclass
class Level:
    """Contexts of one length: grams with counts, and per context what escaping from it costs."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray  # N, the context's count
    kinds: np.ndarray  # T, its distinct symbols
    rest: np.ndarray  # N + T of the next shorter context, without the symbols seen here


class Trie:
    """The model: log10 probabilities of grams."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels: list[Level] = []
        for k, (keys, counts) in enumerate(levels):
            by = np.argsort(keys)
            keys, counts = keys[by].astype(np.int64), counts[by].astype(np.float64)
            contexts, first = np.unique(keys >> 8, return_index=True)
            total = np.add.reduceat(counts, first) if len(keys) else np.empty(0)
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            if not k:
                rest = SYMBOLS - kinds
            else:
                low = self.levels[k - 1]
                mask = (1 << 8 * k) - 1
                below = low.counts[np.searchsorted(low.grams, keys & mask)] if len(keys) else counts
                at = np.searchsorted(low.contexts, contexts & (mask >> 8))
                taken = np.add.reduceat(below, first) if len(keys) else np.empty(0)
                rest = low.total[at] - taken + low.kinds[at] - kinds if len(keys) else np.empty(0)
            self.levels.append(Level(keys, counts, contexts, total, kinds, rest))
        for lv in self.levels:  # exact up to 2**24, and to seven digits beyond
            lv.counts, lv.total, lv.kinds, lv.rest = (x.astype(np.float32) for x in (lv.counts, lv.total, lv.kinds, lv.rest))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after the others."""
        out = np.zeros(len(wanted))
        todo = np.arange(len(wanted))
        # of the shorter context at hand: its divisor after exclusions (NaN where no context was known yet), and the kinds excluded
        divisor, gone = np.full(len(wanted), np.nan), np.zeros(len(wanted))
        for k in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[k]
            if not len(lv.grams):
                continue
            g = wanted[todo] & ((1 << 8 * (k + 1)) - 1)
            c = np.searchsorted(lv.contexts, g >> 8).clip(max=len(lv.contexts) - 1)
            known = lv.contexts[c] == g >> 8
            d = np.where(np.isnan(divisor[todo]), lv.total[c] + lv.kinds[c], divisor[todo])
            i = np.searchsorted(lv.grams, g).clip(max=len(lv.grams) - 1)
            hit = known & (lv.grams[i] == g)
            out[todo[hit]] += np.log10(lv.counts[i[hit]] / d[hit])
            miss = known & ~hit
            # a divisor of zero: all symbols of this context are excluded, and the escape is certain
            cost = miss & (d > 0)
            out[todo[cost]] += np.log10((lv.kinds[c[cost]] - gone[todo[cost]]) / d[cost])
            divisor[todo[miss]] = lv.rest[c[miss]]
            gone[todo[miss]] = lv.kinds[c[miss]]
            todo = todo[~hit]
        out[todo] -= np.log10(np.where(np.isnan(divisor[todo]), SYMBOLS, divisor[todo]))
        return out


def count_grams(df: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """(gram, n): all symbols of the texts in their longest contexts, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            distinct, where = np.unique(k, return_inverse=True)
            return distinct, np.bincount(where, n, len(distinct)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

        for batch in batches:
            texts = encoded(batch.column(0))
            for s in chunks(texts):
                every = grams(texts[s], order)[0]
                if order > 1:
                    k, n = np.unique(every, return_counts=True)
                else:
                    n = np.bincount(every)
                    k = np.flatnonzero(n)
                    n = n[k]
                keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, n]))
                if len(keys) > 1 << 20:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    return df.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str, order: int = ORDER, max_nodes: int | None = None) -> Trie:
    """The trie of all texts in the driver's memory; with `max_nodes`, of those with the highest counts (and order zero)."""
    full = checkpoint(count_grams(df, text, order))
    # a node of each order; counts of shorter contexts are sums over the longer ones
    nodes = full.withColumn("k", F.lit(order))
    for k in range(order):
        short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        nodes = nodes.unionByName(full.groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(k)))
    if max_nodes is not None:
        # the least count kept, found by counts' size classes (sixteenths of a power of two)
        size = F.floor(F.log2("n") * 16)
        least, held = 0, 0
        for c, n in sorted(nodes.where("k > 0").groupBy(size.alias("c")).agg(F.count("*").alias("n")).collect(), reverse=True):
            held += n
            if held > max_nodes:
                least = c + 1
                break
        nodes = nodes.where((size >= least) | (F.col("k") == 0))
    kept = nodes.toArrow()
    order_of, gram, n = (kept[c].to_numpy() for c in ("k", "gram", "n"))
    return Trie([(gram[order_of == k], n[order_of == k]) for k in range(order + 1)])


def levels_of(gram: np.ndarray, n: np.ndarray, lowest: int, highest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of each order from the lowest to the highest, by counts of the longest grams (those that training has)."""
    gram, n = gram[n > 0], n[n > 0]
    out = []
    for k in range(lowest, highest + 1):
        keys, where = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((keys, np.bincount(where, n, len(keys))))
    return out


def spread(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def spans(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each bucket begins and ends, of places in bucket order."""
    kinds, first = np.unique(bucket, return_index=True)
    ends = np.append(first, len(bucket))
    return {b: (a, z) for b, a, z in zip(kinds.tolist(), ends[:-1].tolist(), ends[1:].tolist())}


@dataclass
class Grams:
    """Distinct grams of a block's texts in bucket order, and for each chunk of texts its symbols' places among them and their texts."""

    kinds: np.ndarray
    bucket: np.ndarray
    parts: list[tuple[slice, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[bytes], order: int, buckets: int) -> Grams:
        parts = []
        for s in chunks(texts):
            parts.append((s, *distinct_grams(texts[s], order)))
        every = np.unique(np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]))
        bucket = spread(every, buckets)
        by = np.argsort(bucket, kind="stable")
        back = np.empty(len(by), np.int32)
        back[by] = np.arange(len(by))
        return cls(every[by], bucket[by], [(s, back[np.searchsorted(every, k)][where], owner) for s, k, where, owner in parts])

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often texts have each gram, each text by its weight."""
        n = np.zeros(len(self.kinds))
        for s, where, owner in self.parts:
            n += np.bincount(where, weight[s][owner], len(n))
        return n.astype(np.uint32)

    def scores(self, logs: np.ndarray, texts: int) -> np.ndarray:
        """Each text's sum of its symbols' values."""
        out = np.zeros(texts)
        for s, where, owner in self.parts:
            out[s] = np.bincount(owner, logs[where], s.stop - s.start)
        return out


@dataclass
class Words:
    """Words of a block's texts with an end each, as places in its distinct hashes (in bucket order)."""

    hashes: np.ndarray
    bucket: np.ndarray
    where: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], buckets: int) -> Words:
        split = [[*t.lower().split(), b""] for t in texts]  # the empty word is the end
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array([w for d in split for w in d], pa.binary()).dictionary_encode()
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((h, bucket))
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        return cls(h[by], bucket[by], back[coded.indices.to_numpy()], sizes)


@dataclass(frozen=True)
class Plan:
    text: str
    train: str
    order: int
    buckets: int

    def send(self, table: pa.Table) -> pa.Table:
        """A block's distinct words and grams and how often its training texts have them."""
        texts = encoded(table[self.text])
        w, g = Words.of(texts, self.buckets), Grams.of(texts, self.order, self.buckets)
        train = table[self.train].to_numpy().astype(np.int64)
        n = np.bincount(w.where, np.repeat(train, w.sizes), len(w.hashes)).astype(np.uint32)
        m = g.counts(train)
        of_words, of_grams, block = spans(w.bucket), spans(g.bucket), table["block"][0].as_py()
        buckets = sorted({*of_words, *of_grams})
        cut = lambda x, at: pa.array([planes(x[slice(*at.get(b, (0, 0)))]) for b in buckets], pa.binary())
        return pa.table(
            {
                "block": pa.array([block] * len(buckets), pa.int64()),
                "bucket": pa.array(buckets, pa.int64()),
                "hashes": cut(w.hashes, of_words),
                "counts": cut(n, of_words),
                "grams": cut(g.kinds, of_grams),
                "seen": cut(m, of_grams),
            }
        )

    def price(self, table: pa.Table, low: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        """Log-probabilities of distinct grams; the table has all grams of their contexts' last LOW + 1 bytes."""
        gram = table["gram"].to_numpy()
        model = Trie([*low, *levels_of(gram, table["n"].to_numpy(), LOW + 1, self.order)])
        return pa.table({"bucket": spread(gram, self.buckets), "gram": gram, "log": model(gram)})

    def score(self, table: pa.Table, replies: pa.Table, key: str) -> pa.Table:
        texts = encoded(table[self.text])
        w, g = Words.of(texts, self.buckets), Grams.of(texts, self.order, self.buckets)
        count, logs = np.zeros(len(w.hashes), np.uint64), np.full(len(g.kinds), np.nan)
        of_words, of_grams = spans(w.bucket), spans(g.bucket)
        for b, total, log in zip(*(replies[c].to_pylist() for c in ("bucket", "totals", "logs"))):
            count[slice(*of_words.get(b, (0, 0)))] = numbers(total, np.uint64)
            logs[slice(*of_grams.get(b, (0, 0)))] = unrounded(log)
        first = np.cumsum(w.sizes) - w.sizes
        sums = lambda x: np.add.reduceat(x[w.where], first) if len(first) else x[:0]
        return pa.table(
            {
                key: table[key],
                "held_out": pc.invert(table[self.train]),
                "n_tokens": w.sizes,
                "n_known": sums((count > 0).astype(np.int64)),
                "log_counts": sums(np.log10(count + 0.1)),
                "score": g.scores(logs, len(texts)),
            }
        )


def merged(keys: list[bytes], counts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of packed lists, their places, and their totals."""
    kinds, where = np.unique(np.concatenate([np.empty(0, kind), *(numbers(x, kind) for x in keys)]), return_inverse=True)
    return kinds, where, np.bincount(where, np.concatenate([np.empty(0, np.uint32), *(numbers(x, np.uint32) for x in counts)]), len(kinds)).astype(np.int64)


def count_bucket(table: pa.Table) -> pa.Table:
    """A bucket's distinct grams and how often training has them."""
    kinds, _, total = merged(table["grams"].to_pylist(), table["seen"].to_pylist(), np.int64)
    return pa.table({"gram": kinds, "n": total})


def count_words(table: pa.Table) -> pa.Table:
    """How many words and tokens of training a bucket has."""
    _, _, total = merged(table["hashes"].to_pylist(), table["counts"].to_pylist(), np.uint64)
    return pa.table({"known": pa.array([int((total > 0).sum())], pa.int64()), "tokens": pa.array([int(total.sum())], pa.int64())})


def reply(table: pa.Table, priced: pa.Table) -> pa.Table:
    """To each block the counts of its words and the log-probabilities of its grams, in the order sent."""
    hashes, wanted = table["hashes"].to_pylist(), table["grams"].to_pylist()
    _, where, total = merged(hashes, table["counts"].to_pylist(), np.uint64)
    ends = np.cumsum([0, *(len(x) // 8 for x in hashes)])
    gram, log = priced["gram"].to_numpy(), priced["log"].to_numpy()
    by = np.argsort(gram)
    gram, log = gram[by], log[by]
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "totals": pa.array([planes(total[where[a:z]]) for a, z in zip(ends[:-1], ends[1:])], pa.binary()),
            "logs": pa.array([rounded(log[np.searchsorted(gram, numbers(x, np.int64))]) for x in wanted], pa.binary()),
        }
    )


def score_texts(df: DataFrame, train_on, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; `train_on`: the condition for training rows."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(text), F.coalesce(train_on, F.lit(False)).alias("_train"))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(max(8, -(-size // BLOCK_BYTES)))
    plan = Plan(text, "_train", order, n)
    short = count_grams(rows.where("_train"), text, min(LOW, order)).toArrow()
    low = levels_of(short["gram"].to_numpy(), short["n"].to_numpy(), 0, min(LOW, order))
    docs = rows.withColumn("block", F.pmod(F.xxhash64(key, text), F.lit(n)))
    blocks = docs.groupBy("block")
    sent = blocks.applyInArrow(lambda t: plan.send(t), "block long, bucket long, hashes binary, counts binary, grams binary, seen binary").groupBy("bucket")
    # all grams with the same two bytes before the symbol in one part
    ends = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))
    parts = sent.applyInArrow(count_bucket, "gram long, n long").withColumn("part", F.pmod(F.xxhash64(ends), F.lit(n))).groupBy("part")
    priced = parts.applyInArrow(lambda t: plan.price(t, low), "bucket long, gram long, log double")
    replies = sent.cogroup(priced.groupBy("bucket")).applyInArrow(reply, "block long, bucket long, totals binary, logs binary")
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, score double"
    scored = blocks.cogroup(replies.groupBy("block")).applyInArrow(lambda t, r: plan.score(t, r, key), out)
    totals = sent.applyInArrow(count_words, "known long, tokens long").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"))
    total = totals.select(F.struct("v", "n")).scalar()
    return (
        scored.withColumn("_t", total)
        .withColumn("base_score", F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("_t.n") + 0.1 * (F.col("_t.v") + 1)))
        .select(key, "held_out", "n_tokens", "n_known", F.col("_t.n").alias("train_tokens"), "base_score", "score")
    )
