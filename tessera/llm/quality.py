"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by its make-up
(kinds of characters, words and their repetition, hashed byte pairs); a hidden
layer, a gated attention over the passages and a logistic output are learned
from document labels, so that the weighted passages stand for the document.

The network is fitted on a bounded sample of labelled rows (those with the
smallest key hashes); every document is scored, whole.  Null and empty texts
are one empty passage.  Contradicting labels of a key count as their mean.
Without labels of both kinds the score is the mean label (0.5 without any).
Rows are scored each; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, encoded

#: Bytes of a passage.
PASSAGE = 512
#: Labelled documents fitted on, at most, and passages of each of them, evenly spread (scores are of all passages).
SAMPLE, BAG = 6000, 1024
HIDDEN, GATE, EPOCHS, BATCH = 24, 12, 25, 128
PAIRS = 64
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!", b"?", b"'\"()-", b"|", b"#$%&*", b"@/\\_=<>[]{}~^+`"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _c in enumerate(_KINDS):
    _KIND[list(_c)] = _i
WIDTH = len(_KINDS) + 1 + 6 + PAIRS
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_M = np.uint64(0x9E3779B97F4A7C15)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (one at least)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    passages = np.maximum(1, -(-(sizes - 1) // PASSAGE))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(flat)) - first[owner]
    base = np.cumsum(passages) - passages
    cell = base[owner] + np.minimum(within // PASSAGE, passages[owner] - 1)
    n = int(passages.sum())
    real = within < sizes[owner] - 1
    x = np.zeros((n, WIDTH))
    long = np.bincount(cell[real], minlength=n) + 1.0
    kinds = _KIND[flat]
    for k in range(len(_KINDS) + 1):
        x[:, k] = np.bincount(cell[real & (kinds == k)], minlength=n) / long
    # words: hashes from running sums of byte times power, so that no loop is needed
    at = len(_KINDS) + 1
    blank = _SPACE[flat]
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if len(start):
        stop = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        place = np.arange(len(flat), dtype=np.uint64) - np.repeat(start.astype(np.uint64), np.diff(np.append(start, len(flat)))) if start[0] == 0 else None
        if place is None:
            place = np.concatenate((np.zeros(start[0], np.uint64), np.arange(start[0], len(flat), dtype=np.uint64) - np.repeat(start.astype(np.uint64), np.diff(np.append(start, len(flat))))))
        letter = (flat.astype(np.uint64) + np.uint64(1)) * ((place + np.uint64(1)) * _M ^ (place * place * _M >> np.uint64(7)))
        letter[blank] = 0
        h = np.add.reduceat(letter, start)
        home = cell[start]
        words = np.bincount(home, minlength=n) + 1.0
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (owner[start[1:]] == owner[start[:-1]])))
        pair = (home.astype(np.uint64) * _M) ^ h
        new = np.zeros(len(h), bool)
        new[np.unique(pair, return_index=True)[1]] = True
        whole = (owner[start].astype(np.uint64) * _M) ^ (h * np.uint64(3))
        once = np.zeros(len(h), bool)
        once[np.unique(whole, return_index=True)[1]] = True
        size = stop - start
        x[:, at] = np.log(words)
        x[:, at + 1] = np.bincount(home, size, n) / words / 10
        x[:, at + 2] = np.bincount(home, same, n) / words
        x[:, at + 3] = np.bincount(home, new, n) / words
        x[:, at + 4] = np.bincount(home, once, n) / words
        x[:, at + 5] = np.bincount(home, ~np.isin(flat[stop - 1], list(_KINDS[0] + _KINDS[1])) & (flat[stop - 1] < 128), n) / words
    both = real[1:] & real[:-1] & (owner[1:] == owner[:-1])
    pairs = ((flat[1:].astype(np.uint64) << np.uint64(8) | flat[:-1]) * _M >> np.uint64(58)).astype(np.int64)
    x[:, at + 6 :] = np.bincount(cell[1:][both] * PAIRS + pairs[both], minlength=n * PAIRS).reshape(n, PAIRS) / long[:, None] * 4
    return x, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = ((x - self.mean) / self.scale).clip(-6, 6)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        att = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(h * att[:, None], first, axis=0)
        return z @ p["c"] + p["d"], {"x": x, "h": h, "t": t, "g": g, "att": att, "z": z, "owner": owner, "first": first}

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, m = self.forward(x, sizes)
        dl = (_sigmoid(logit) - y) * weight / len(y)
        dz = dl[:, None] * p["c"]
        per = dz[m["owner"]]
        da = (per * m["h"]).sum(axis=1)
        de = m["att"] * (da - np.add.reduceat(da * m["att"], m["first"])[m["owner"]])
        dt, dg = de[:, None] * m["g"] * p["a"] * (1 - m["t"] ** 2), de[:, None] * m["t"] * p["a"] * m["g"] * (1 - m["g"])
        dh = (per * m["att"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - m["h"] ** 2)
        return {"w": m["x"].T @ dh, "b": dh.sum(axis=0), "v": m["h"].T @ dt, "u": m["h"].T @ dg, "a": (de[:, None] * m["t"] * m["g"]).sum(axis=0), "c": m["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.forward(*encode(texts))[0]) if texts else np.empty(0)


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": small(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": small(HIDDEN, GATE), "u": small(HIDDEN, GATE), "a": small(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, p)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        p["d"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    m1, m2, step = {k: 0.0 * v for k, v in p.items()}, {k: 0.0 * v for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            step += 1
            g = net.gradient(np.concatenate([bags[j] for j in at]), np.array([len(bags[j]) for j in at]), y[at], weight[at])
            for k, v in g.items():
                v = v + 1e-4 * p[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.999 * m2[k] + 0.001 * v * v
                p[k] -= 0.01 * (1 - epoch / EPOCHS) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """Fit on at most `sample` labelled documents; `labels` holds the rows to learn from."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)  # bounded by the parameter, so it may be broadcast
    rows = df.select(F.col(key), F.col(text)).join(F.broadcast(chosen), key).select("_y", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for s in chunks(texts):
                x, sizes = encode(texts[s])
                parts = [q if len(q) <= BAG else q[np.linspace(0, len(q) - 1, BAG).astype(int)] for q in np.split(x.astype(np.float32), np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, len(sizes)), pa.array([q.tobytes() for q in parts], pa.binary())], ["y", "bag"])

    got = rows.mapInArrow(run, "y double, bag binary").toArrow()
    pairs = sorted(zip(got["bag"].to_pylist(), got["y"].to_pylist()))
    return fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(np.float64) for b, _ in pairs], np.array([q for _, q in pairs]))


def score(df: DataFrame, model: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for s in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), pa.array(held.value.score(texts[s]))], [key, "score"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")
