import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.errors import CorruptFilter, CorruptRuns, InvalidParameters
from tessera.functions import bloom, rle
from tessera.functions.bloom import BloomFilter, hash128, key_bytes, key_matrix


def plain_hash(key):
    h = 0x6C62272E07BB014262B821756295C58D
    for b in key:
        h = (h ^ b) * ((1 << 88) + 0x13B) % (1 << 128)
    return h >> 64, h % (1 << 64)


@given(st.lists(st.binary(max_size=20), min_size=1, max_size=5))
def test_hash_is_fnv(keys):
    for k in keys:
        hi, lo = BloomFilter._one(k)
        assert (int(hi[0]), int(lo[0])) == plain_hash(k)


@given(st.lists(st.text(max_size=9), min_size=1, max_size=8))
def test_hash_of_strings_of_any_length(keys):
    hi, lo = hash128(*key_matrix(keys, "string"))
    assert [(int(a), int(b)) for a, b in zip(hi, lo)] == [plain_hash(key_bytes(k, "string")) for k in keys]


@pytest.mark.parametrize("p, rate, size", [(0.01, 0.012421, 119_814), (0.001, 0.001014, 179_720)])
def test_published_rates(p, rate, size):
    f = BloomFilter.sized(100_000, p)
    f.add_hashed(*hash128(*key_matrix(np.arange(100_000), "int64")))
    assert f.contains_hashed(*hash128(*key_matrix(np.arange(100_000), "int64"))).all()
    assert f.contains_hashed(*hash128(*key_matrix(np.arange(100_000, 1_100_000), "int64"))).mean() == pytest.approx(rate, abs=1e-9)
    assert len(f.bits) == size


def test_sizing():
    f = BloomFilter.sized(1_000_000, 0.01)
    assert (f.m, f.k) == (9_585_059, 7)
    assert BloomFilter.sized(1, 0.999999).k == 1
    assert BloomFilter.sized(10, 1e-30).k == 30
    for n, p in [(0, 0.1), (5, 0), (5, 1), (5, math.nan), (5, -1)]:
        with pytest.raises(InvalidParameters):
            BloomFilter.sized(n, p)


def test_bytes_round_trip_and_corruption():
    f = BloomFilter.sized(100, 0.05)
    f.add(b"x")
    back = BloomFilter.from_bytes(f.to_bytes())
    assert b"x" in back and b"y" not in back and back.n_added == 1 and back.estimated_rate == f.estimated_rate > 0
    raw = f.to_bytes()
    for bad in (b"", raw[:10], raw[:-1], raw + b"z", raw[:8] + b"\0" + raw[9:], bytes(8) + raw[8:], raw[:8] + b"\x1f" + raw[9:]):
        with pytest.raises(CorruptFilter):
            BloomFilter.from_bytes(bad)
    assert BloomFilter.sized(10, 0.1).estimated_rate == 0


@given(st.lists(st.integers(0, 40), max_size=60), st.sampled_from([3, 10, 1 << 13]))
def test_admission_equals_asking_one_by_one(keys, block):
    one, all_ = BloomFilter.sized(10, 0.3), BloomFilter.sized(10, 0.3)
    want = []
    for k in keys:
        b = key_bytes(k, "int64")
        want.append(b not in one)
        if want[-1]:
            one.add(b)
    bloom.BLOCK, kept = block, bloom.BLOCK
    got = all_.admit(*hash128(*key_matrix(np.array(keys, np.int64), "int64")))
    bloom.BLOCK = kept
    assert got.tolist() == want and (one.bits == all_.bits).all() and one.n_added == all_.n_added


_VALUES = {"int64": st.integers(-(1 << 63), (1 << 63) - 1), "float64": st.floats(), "string": st.text(max_size=5)}


@pytest.mark.parametrize("kind", _VALUES)
@given(data=st.data())
def test_run_codec(kind, data):
    few = data.draw(st.lists(_VALUES[kind], max_size=4))
    values = data.draw(st.lists(st.sampled_from(few), max_size=30)) if few else []
    for enc, dec in ((rle.encode, rle.decode), (rle.encode_raw, rle.decode_raw)):
        back = dec(enc(values, kind), kind, len(values))
        assert list(map(repr, map(float, back) if kind == "float64" else back)) == list(map(repr, map(float, values) if kind == "float64" else values)) or kind == "int64" and list(back) == values


def test_run_codec_corruption():
    raw = rle.encode([1, 1, 2], "int64")
    for bad, n in ((raw[:-1], 3), (raw, 2), (raw, 4), (b"\x80", 1), (b"\0" + bytes(8), 0)):
        with pytest.raises(CorruptRuns):
            rle.decode(bad, "int64", n)
    assert len(rle.encode(list(range(1000)), "int64")) == 9000
    assert len(rle.encode([7] * 1000, "int64")) == 10


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_runs_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(rle, "CHUNK", chunk)
    values = [1.5, 1.5, 0.0, -0.0, math.nan, math.nan, math.nan, math.nan, 2.0, 2.0, 2.0, 2.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, _seq long").repartition(3)
    got = sorted((r["first"], r["n"]) for r in rle.runs(df, "v").collect())
    assert got == [(0, 2), (2, 1), (3, 1), (4, 4), (8, 4)]
    assert sorted(r.row for r in rle.expanded(rle.runs(df, "v")).collect()) == list(range(len(values)))


@pytest.mark.parametrize("chunk", [2, 5, 1 << 20])
def test_runs_over_gaps(spark, monkeypatch, chunk):
    monkeypatch.setattr(rle, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    for _ in range(4):
        values = [str(v) for v in rng.choice(list("ab"), 40, p=[0.8, 0.2])]
        order = np.sort(rng.choice([*range(30), *range(1 << 33, (1 << 33) + 30), *range(5 << 33, (5 << 33) + 30)], 40, replace=False)).tolist()
        starts = [i for i in range(40) if i == 0 or values[i] != values[i - 1]]
        want = [(order[i], i, values[i], j - i) for i, j in zip(starts, [*starts[1:], 40])]
        got = rle.runs(spark.createDataFrame(list(zip(values, order)), "v string, _seq long"), "v").collect()
        assert sorted(map(tuple, got)) == want
    same = spark.createDataFrame([("x", i) for i in [*range(5), *range(1 << 33, (1 << 33) + 5)]], "v string, _seq long")
    assert [tuple(r) for r in rle.runs(same, "v").collect()] == [(0, 0, "x", 10)]


def test_size_model_is_the_codec(spark):
    for kind, t, values in (("string", "string", ["a", "a", "", "bbb"] * 50 + ["é"] * 300), ("int64", "long", [1, 1, 2] * 70), ("int64", "long", [5] * 20_000)):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {t}, _seq long")
        assert rle.sizes(df, "v").first().rle_bytes == len(rle.encode(values, kind))
