"""BPE encoding and decoding: speculate, verify, repair.

The distinct words of a batch are cut greedily into longest vocabulary entries
(the guess), all at once, by walking a trie in step.  A token sequence is what
the merge rules give exactly if every token is its own encoding and every
adjacent pair is the encoding of its concatenation, so the guesses are checked
pair by pair with array look-ups; only words with a failing pair go through the
merges themselves, which are done in step too, one merge of each word a round.
Words of over LONG bytes are rare and merged one by one, in n log n steps.

Nothing is remembered between batches but which pairs of tokens are sound.

Null texts are empty and have no ids.  Rows are independent: repeated rows,
repeated keys and extra columns do no harm, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import encoded, portions, table

#: Bytes of a word that is guessed and merged together with others, at most.
LONG = 64
#: Pairs of tokens whose verdict is remembered; past it they are judged anew, results don't change.
PAIRS = 1 << 20
#: The symbol after a word's last byte in the trie.
STOP = 256


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


LETTERS = _byte_letters()


class Lookup:
    """A hash table from whole numbers to whole numbers, asked for many at a time; -1 stands for none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held, out = self.keys[at], self.values[at]
        other = held != keys
        out[other] = -1
        todo = np.flatnonzero(other & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


class Ragged:
    """Lists of whole numbers, end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, np.asarray(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = self.sizes[rows]
        first = np.cumsum(sizes) - sizes
        return Ragged(self.flat[np.arange(int(sizes.sum())) + np.repeat(self.first[rows] - first, sizes)], sizes)

    def put(self, rows: np.ndarray, other: Ragged) -> None:
        """Fill in lists whose sizes are known."""
        self.flat[np.arange(len(other.flat)) + np.repeat(self.first[rows] - other.first, other.sizes)] = other.flat


class Tokenizer:
    """Encoder and decoder for a tokenizer file of the BPE kind with word ends."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model = d["model"]
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        known = model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and d["decoder"] is None and not model["unk_token"] and end
        if not known or any(x not in vocab or x + end not in vocab for x in LETTERS):
            raise ValueError("this kind of tokenizer file is not supported")
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # runs of white space only part words, so they needn't be replaced before
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.plain_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
        self.base = np.array([vocab[x] for x in LETTERS], np.int32)
        self.last = np.array([vocab[x + end] for x in LETTERS], np.int32)
        # merges: a pair's rank, and by rank what it becomes
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in map(tuple, model["merges"])]
        self.none = len(pairs)
        left, right, self.product = np.array(pairs, np.int64).reshape(-1, 3).T
        self.rank = Lookup(left << 20 | right, np.arange(len(pairs)))
        self.ranks = dict(zip((left << 20 | right).tolist(), range(len(pairs))))
        # entries as bytes, with STOP where a word ends
        letter = {c: b for b, c in enumerate(LETTERS)}
        spelt = {i: [*(letter[c] for c in t.removesuffix(end)), *([STOP] if t.endswith(end) else [])] for t, i in vocab.items() if t != end and all(c in letter for c in t.removesuffix(end))}
        self.top = max(names) + 1
        nodes: dict[int, int] = {}
        accept = [-1]
        for i, t in spelt.items():
            at = 0
            for c in t:
                at = nodes.setdefault(at * (STOP + 1) + c, len(accept))
                if at == len(accept):
                    accept.append(-1)
            accept[at] = i
        self.trie, self.accept = Lookup(np.fromiter(nodes.keys(), np.int64), np.fromiter(nodes.values(), np.int64)), np.array(accept, np.int32)
        symbols = [self.symbols(spelt.get(i, [])) for i in range(self.top)]
        self.spelt = Ragged(np.concatenate(symbols), [len(x) for x in symbols])
        whole = self.merged(self.spelt)
        self.alone = (whole.sizes == 1) & (self.spelt.sizes > 0)
        self.alone[self.alone] = whole.flat[whole.first[self.alone]] == np.flatnonzero(self.alone)
        self.codes, self.sound = np.empty(0, np.int64), np.empty(0, bool)
        self.place = np.full(self.top, -1, np.int64)
        self.place[sorted(names)] = np.arange(len(names))
        self.names = pa.array([names[i] for i in sorted(names)], pa.string())

    def symbols(self, spelt: list[int]) -> np.ndarray:
        """What merging starts from."""
        if spelt[-1:] == [STOP]:
            body = np.array(spelt[:-1], np.int64)
            return np.concatenate((self.base[body[:-1]], self.last[body[-1:]]))
        return self.base[np.array(spelt, np.int64)]

    # -- exact merging -------------------------------------------------

    def merged_long(self, ids: list[int]) -> list[int]:
        """The merge rules applied to one sequence: lowest rank first, leftmost first."""
        n, rank, product = len(ids), self.ranks, self.product
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank.get(ids[i] << 20 | ids[j]) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = int(product[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def merged(self, of: Ragged) -> Ragged:
        """The merge rules applied to all sequences, one merge of each a round."""
        sizes = of.sizes.copy()
        parts: list[tuple[np.ndarray, Ragged]] = []
        low = 0
        for width in (*(w for w in (4, 8, 12, 16, 24, 32) if w < LONG), LONG):
            rows = np.flatnonzero((of.sizes > low) & (of.sizes <= width))
            for i in range(0, len(rows), 1 << 14):
                parts.append((rows[i : i + (1 << 14)], self._merged(of.take(rows[i : i + (1 << 14)]), width)))
            low = width
        rows = np.flatnonzero(of.sizes > LONG)
        if len(rows):
            done = [self.merged_long(of.flat[a : a + n].tolist()) for a, n in zip(of.first[rows].tolist(), of.sizes[rows].tolist())]
            parts.append((rows, Ragged(np.fromiter(chain.from_iterable(done), np.int32), np.fromiter(map(len, done), np.int64))))
        for rows, part in parts:
            sizes[rows] = part.sizes
        out = Ragged(np.empty(int(sizes.sum()), np.int32), sizes)
        for rows, part in parts:
            out.put(rows, part)
        return out

    def _merged(self, of: Ragged, width: int) -> Ragged:
        n = len(of.sizes)
        out = np.full((n, width), -1, np.int32)
        out[np.repeat(np.arange(n), of.sizes), np.arange(len(of.flat)) - np.repeat(of.first, of.sizes)] = of.flat
        ids, rows = out.copy(), np.arange(n)
        ranks = np.full((n, width - 1), self.none, np.int32)
        real = ids[:, 1:] >= 0
        ranks[real] = self._ranked(ids[:, :-1][real], ids[:, 1:][real])
        place = np.arange(width)
        while len(rows):
            k = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), k]
            go = best < self.none
            if not go.all():
                out[rows[~go]] = ids[~go]
                ids, ranks, rows, k, best = ids[go], ranks[go], rows[go], k[go], best[go]
                if not len(rows):
                    break
            all_rows = np.arange(len(rows))
            # the pair becomes one, and what is behind it moves up
            ids[:, 1:-1] = np.where(place[1:-1] > k[:, None], ids[:, 2:], ids[:, 1:-1])
            ids[:, -1] = -1
            ids[all_rows, k] = self.product[best]
            ranks[:, :-1] = np.where(place[: width - 2] >= k[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.none
            some = all_rows[k > 0]
            at = k[some]
            ranks[some, at - 1] = self._ranked(ids[some, at - 1], ids[some, at])
            some = all_rows[k < width - 2]
            at = k[some]
            follows = ids[some, at + 1]
            ranks[some, at] = np.where(follows >= 0, self._ranked(ids[some, at], np.maximum(follows, 0)), self.none)
        left = out >= 0
        return Ragged(out[left], left.sum(axis=1))

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank(a.astype(np.int64) << 20 | b)
        r[r < 0] = self.none
        return r

    # -- guess and check -----------------------------------------------

    def guess(self, flat: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Ragged:
        """Longest entries from the left, of words that end with STOP; nothing where some byte has none."""
        flat = np.append(flat, STOP)
        word, at, stop = np.arange(len(first)), first.copy(), stop.copy()
        node, best, upto = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int32), at.copy()
        whose, what = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        while len(word):
            c = flat[at]
            node = self.trie(node * (STOP + 1) + c).astype(np.int64)
            # an entry without a word's end can't be the last one
            token = np.where((node >= 0) & ((c == STOP) | (flat[at + 1] != STOP)), self.accept[node], -1)
            at += 1
            hit = token >= 0
            best[hit], upto[hit] = token[hit], at[hit]
            ends = np.flatnonzero((node < 0) | (at == stop))
            if len(ends):
                found = ends[best[ends] >= 0]
                whose.append(word[found])
                what.append(best[found])
                at[ends], node[ends] = upto[ends], 0
                left = np.ones(len(word), bool)
                left[ends] = (best[ends] >= 0) & (upto[ends] < stop[ends])
                if (failed := ends[best[ends] < 0]).size:
                    whose.append(word[failed])
                    what.append(np.full(len(failed), -1, np.int32))
                best[ends] = -1
                word, at, stop, node, best, upto = word[left], at[left], stop[left], node[left], best[left], upto[left]
        owner, ids = np.concatenate(whose), np.concatenate(what)
        by = np.argsort(owner, kind="stable")
        owner, ids = owner[by], ids[by]
        bad = np.zeros(len(first), bool)
        bad[owner[ids < 0]] = True
        good = ~bad[owner]
        return Ragged(ids[good], np.bincount(owner[good], minlength=len(first)))

    def _judged(self, codes: np.ndarray) -> np.ndarray:
        """Of pairs of tokens (distinct, in order), whether their concatenation is encoded as just those two."""
        at = np.searchsorted(self.codes, codes).clip(max=max(0, len(self.codes) - 1))
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(new):
            a, b = new >> 20, new & ((1 << 20) - 1)
            both = self.spelt.take(np.stack((a, b), axis=1).ravel())
            got = self.merged(Ragged(both.flat, both.sizes.reshape(-1, 2).sum(axis=1)))
            fine = got.sizes == 2
            fine[fine] = (got.flat[got.first[fine]] == a[fine]) & (got.flat[got.first[fine] + 1] == b[fine])
            if len(self.codes) + len(new) > PAIRS:
                seen = np.isin(self.codes, codes, assume_unique=True)
                self.codes, self.sound = self.codes[seen], self.sound[seen]
            self.codes, self.sound = np.concatenate((self.codes, new)), np.concatenate((self.sound, fine))
            by = np.argsort(self.codes)
            self.codes, self.sound = self.codes[by], self.sound[by]
            at = np.searchsorted(self.codes, codes)
        return self.sound[at]

    def encoded(self, words: pa.StringArray) -> Ragged:
        """Ids of distinct words that aren't empty."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] if len(ends) else 0 : ends[-1] if len(ends) else 0]
        ends = ends - ends[0]
        sizes = np.diff(ends)
        symbols = self.base[data]
        symbols[ends[1:] - 1] = self.last[data[ends[1:] - 1]]
        spelt = Ragged(symbols, sizes)
        # with a STOP behind each word
        n = len(words)
        flat = np.full(len(data) + n, STOP, np.int64)
        flat[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
        short = np.flatnonzero(sizes <= LONG)
        first = (ends[:-1] + np.arange(n))[short]
        guess = self.guess(flat, first, first + sizes[short] + 1)
        owner = np.repeat(np.arange(len(short)), guess.sizes)
        good = guess.sizes > 0
        good[owner[~self.alone[guess.flat]]] = False
        near = owner[1:] == owner[:-1]
        codes, where = np.unique(guess.flat[:-1][near].astype(np.int64) << 20 | guess.flat[1:][near], return_inverse=True)
        good[owner[1:][near][~self._judged(codes)[where]]] = False
        rest = np.ones(n, bool)
        rest[short[good]] = False
        rest = np.flatnonzero(rest)
        fine, exact = guess.take(np.flatnonzero(good)), self.merged(spelt.take(rest))
        lengths = np.zeros(n, np.int64)
        lengths[short[good]], lengths[rest] = fine.sizes, exact.sizes
        out = Ragged(np.empty(int(lengths.sum()), np.int32), lengths)
        out.put(short[good], fine)
        out.put(rest, exact)
        return out

    # -- texts -----------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return self.plain_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def segments(self, text: str) -> list[str]:
        """Words and special tokens in order (no word is spelt like a special token)."""
        if not any(s in text for s in self.special):
            return self.pieces(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:])

    def encode(self, texts: list[str]) -> pa.ListArray:
        """One list of ids (int32) for each text."""
        parts = [self.segments(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        if not len(coded):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
        own = self.encoded(coded.dictionary)
        for s, i in self.special.items():
            at = pc.index(coded.dictionary, s).as_py()
            if at >= 0:
                lengths = own.sizes.copy()
                lengths[at] = 1
                fresh = Ragged(np.full(int(lengths.sum()), i, np.int32), lengths)
                rest = np.flatnonzero(np.arange(len(lengths)) != at)
                fresh.put(rest, own.take(rest))
                own = fresh
        each = own.take(coded.indices.to_numpy())
        ends = np.append(each.first, len(each.flat))[_offsets(map(len, parts)).to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each.flat))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by one space (the file has no decoder of its own); null ids are no ids, unknown ones are left out."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        at = np.where((flat >= 0) & (flat < self.top), self.place[flat.clip(0, self.top - 1)], -1)
        good = at >= 0
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(good)))[np.concatenate(([0], np.cumsum(sizes)))]
        names = self.names.take(pa.array(at[good]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names), " ")


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.fromiter(sizes, np.int64)))), pa.int32())


_HELD: dict[int, Tokenizer] = {}


def _held(spec: str) -> Tokenizer:
    k = hash(spec)
    if k not in _HELD:
        _HELD.clear()
        _HELD[k] = Tokenizer(spec)
    return _HELD[k]


def read_spec(path: str) -> str:
    """The tokenizer file's text, read on the driver (a few MB: its size is that of the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def _mapped(df: DataFrame, path: str, column: str, made: dict[str, T.DataType], keep: list[str] | None, work) -> DataFrame:
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]  # columns of those names are replaced
    at = df.columns.index(column)
    places = [df.columns.index(k) for k in keep]
    own = df.select(*[F.col(f"`{k}`") for k in keep]).schema.fields
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _held(spec.value)
        for batch in batches:
            for start, size, columns in work(tok, batch.column(at)):
                part = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *columns], names=[*keep, *made])

    return df.mapInArrow(run, schema)


def _encoded(tok: Tokenizer, column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for start, texts in portions(column):
        yield start, len(texts), [tok.encode([t.decode() for t in texts])]


def _decoded(tok: Tokenizer, column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for i in range(0, len(column), 200):
        part = column.slice(i, 200)
        yield i, len(part), [tok.decode(part)]


def _both(tok: Tokenizer, column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for start, size, (ids,) in _encoded(tok, column):
        yield start, size, [ids, tok.decode(ids)]


def _hashed(tok: Tokenizer, column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for start, size, (ids, decoded) in _both(tok, column):
        spelt = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in encoded(c)], pa.string()) for c in (spelt, decoded)]
        yield start, size, [pc.list_value_length(ids).cast(pa.int64()), *digests]


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The table's columns (or those in `keep`) and one more: array<int> of token ids of the whole text."""
    return _mapped(df, path, text, {out: IDS}, keep, _encoded)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The table's columns (or those in `keep`) and one more: the decoded text of an array of ids."""
    return _mapped(df, path, ids, {out: TEXT}, keep, _decoded)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Encoding and decoding in one worker: the columns to keep, the ids and the text that they decode to."""
    return _mapped(df, path, text, {ids: IDS, decoded: TEXT}, keep, _both)


def bpe_digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep and, of the round trip, the number of ids and SHA-256 of the ids (decimal, joined by a space) and of the decoded text.

    The worker derives them, so that neither ids nor texts go back to the JVM.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": TEXT, "decoded_sha256": TEXT}
    return _mapped(df, path, text, made, keep, _hashed)


def op10_query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
