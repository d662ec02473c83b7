"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells, from hashed
n-grams of the lower-cased letters, on which side of that bit's split of the
languages a text lies.  The classifiers are log-odds of n-gram distributions
that are counted over all training rows (those that no row has tell nothing).  Decoding adds up, for each codeword,
the logistic losses of the bits, each weighted by how far apart its two sides
are, and takes the nearest codeword; a small lead over the next one is flagged.

Null texts and texts without a letter are ``und`` with score 0, as is
everything where nothing was learned.  Ties go to the alphabetically first
language.  Rows are scored independently of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks

LENGTHS = (1, 2, 3, 4)
#: Buckets of each n-gram length.
BUCKETS = 1 << 13
#: Bytes of text worked on at once; each takes some hundred bytes of memory.
CHUNK = 1 << 18
#: Evidence is divided by this: n-grams of four lengths overlap.
OVERLAP = 8.0
#: A lead (in loss) below this is ambiguous: the next codeword has over two thirds of the best one's belief.
LEAD = float(np.log(1.5))
#: So is one below this share of the lead that the language's own n-grams would give a text as long.
USUAL = 0.25
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[A-Za-z]")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> bytes:
    """Lower-cased letters, with one space for each run of anything else; empty if there is no letter."""
    if not text or not (_LETTER.search(text) or any(map(str.isalpha, text))):
        return b""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def features(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram length the bucket at every byte, and the number of bytes (with margins) of each text."""
    gap = b" " * (max(LENGTHS) - 1)
    flat = np.frombuffer(b"".join([gap + t + b" " for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(t) + len(gap) + 1 for t in texts), np.int64, len(texts))
    out, gram = [], flat
    for n in LENGTHS:
        if n > 1:
            gram = flat.copy()
            for k in range(1, n):
                gram[k:] |= flat[:-k] << np.uint64(8 * k)
        out.append(((gram * _MULT) >> np.uint64(51)).astype(np.int64))
    return out, sizes


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: exhaustive codes up to five classes, else random ones with the best least distance of many."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        bits = (np.arange(1, 1 << (k - 1))[None, :] >> np.arange(k)[:, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    rng = np.random.default_rng(seed)
    n = 10 * int(np.ceil(np.log2(k)))
    best = None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, n))
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < k]  # a bit needs both sides
        apart = int((code.shape[1] - code.astype(np.int64) @ code.T.astype(np.int64)).__add__(np.eye(k, dtype=np.int64) * 10 * n).min())
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log-odds
    trust: np.ndarray  # of each bit
    usual: np.ndarray  # of each language: the lead that a byte of it gives on average

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray) -> Model:
        """counts: languages x (lengths * BUCKETS)"""
        p = counts.reshape(len(languages), len(LENGTHS), BUCKETS) + 0.5
        p = (p / p.sum(axis=2, keepdims=True)).reshape(len(languages), len(LENGTHS) * BUCKETS)
        code = codewords(len(languages))
        if len(languages) < 2:
            return cls(languages, code, np.zeros((p.shape[1], code.shape[1]), np.float32), np.ones(code.shape[1]), np.zeros(len(languages)))
        yes = np.stack([p[c > 0].mean(axis=0) for c in code.T], axis=1)
        no = np.stack([p[c < 0].mean(axis=0) for c in code.T], axis=1)
        odds = np.log(yes / no)
        odds[counts.sum(axis=0) == 0] = 0
        apart = ((yes - no) * odds).sum(axis=0)
        trust = apart / apart.mean()
        # evidence of a byte of each language, and what it adds to the loss of each codeword
        each = p @ odds / OVERLAP
        added = (np.maximum(0, -2 * each[:, None, :] * code[None]) * trust).sum(axis=2)
        others = added + np.where(np.eye(len(languages), dtype=bool), np.inf, 0)
        return cls(languages, code, odds.astype(np.float32), trust, np.maximum(0, others.min(axis=1) - added.diagonal()))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each cleaned text."""
        n = len(texts)
        lang, score, unclear = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        some = [i for i, t in enumerate(texts) if t]
        if not some or not self.languages:
            return lang, score, unclear
        grams, sizes = features([texts[i] for i in some])
        first = np.cumsum(sizes) - sizes
        evidence = sum(np.add.reduceat(self.weights[g + k * BUCKETS], first, axis=0, dtype=np.float64) for k, g in enumerate(grams)) / OVERLAP
        loss = (np.logaddexp(0, -2 * evidence[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        best = loss.argmin(axis=1)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score[some] = (odds.max(axis=1) / odds.sum(axis=1)).clip(0, 1)
        two = np.sort(loss, axis=1)
        lead = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(some), np.inf)
        unclear[some] = (lead < LEAD) | (lead < USUAL * self.usual[best] * sizes)
        for i, b in zip(some, best.tolist()):
            lang[i] = self.languages[b]
        return lang, score, unclear


def _cleaned(column: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
    for i in range(0, len(column), 256):
        texts = [letters(t) for t in column.slice(i, 256).to_pylist()]
        for s in chunks(texts, CHUNK):
            yield slice(i + s.start, i + s.stop), texts[s]


def train(df: DataFrame, text: str, lang: str) -> Model:
    """Count n-grams by language over all rows with a language.  Collected: one number per language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for s, texts in _cleaned(batch.column(0)):
                grams, sizes = features(texts)
                names = sorted(set(langs[s]))
                which = np.repeat([names.index(x) for x in langs[s]], sizes)
                wide = len(LENGTHS) * BUCKETS
                for k, g in enumerate(grams):
                    n = np.bincount(which * wide + g + k * BUCKETS, minlength=len(names) * wide).reshape(len(names), wide)
                    for name, row in zip(names, n):
                        seen[name] = seen[name] + row if name in seen else row
        for name, row in seen.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias("lang"))
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(names), len(LENGTHS) * BUCKETS))
    where = {x: i for i, x in enumerate(names)}
    counts[[where[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model.of(names, counts)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The table's columns (or those in `keep`) with lang_pred, score (0 to 1) and ambiguous."""
    made_here = ("lang_pred", "score", "ambiguous")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made_here]  # columns of those names are replaced
    held = df.sparkSession.sparkContext.broadcast(model)  # buckets x bits: its size doesn't depend on the data
    at, places = df.columns.index(text), [df.columns.index(k) for k in keep]
    schema = df.select(*[F.col(f"`{k}`") for k in keep]).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in _cleaned(batch.column(at)):
                lang, score, unclear = held.value.predict(texts)
                part = batch.slice(s.start, len(texts))
                made = [pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *made], [*keep, *made_here])

    return df.mapInArrow(run, schema)
