import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.errors import CorruptSegment, DuplicateColumn, IncompatibleSegment, KeyNotFound, NoColumns, SchemaError, UnknownColumn
from tessera.functions.bloom import BloomFilter, key_bytes
from tessera.operators import dedup
from tessera.operators.table import Options, Table
from tessera.schema import Schema, parse_spec
from tessera.sources import columnfile, files, generate
from tessera.sources.segment import Segment, read_header

SCHEMA = Schema.of("id:int64,amount:float64,country:string", "id")


def test_schema_rules():
    with pytest.raises(NoColumns):
        Schema((), "a").validated()
    with pytest.raises(DuplicateColumn):
        Schema.of([("a", "int64"), ("a", "string")], "a")
    with pytest.raises(KeyNotFound):
        Schema.of("a:int64", "b")
    assert parse_spec(" a : int64 , b:string") == [("a", "int64"), ("b", "string")]
    for bad in ("", "a", "a:Int64", ":int64", "a:int64,", "a:int64,a:string"):
        with pytest.raises(SchemaError):
            parse_spec(bad)
    assert SCHEMA.index("ID") == -1 and SCHEMA.pk_index == 0


def test_first_row_wins_and_bad_rows_are_told(spark, tmp_path):
    t = Table(spark, SCHEMA)
    s = t.insert([(1, 1.0, "a"), (1, 2.0, "b"), (2, 3.0, ""), (3, 1, "int"), (4, None, "x"), ("5", 1.0, "x"), (6, 1.0), (True, 1.0, "x")])
    assert (s.accepted, s.rejected, len(s.errors)) == (2, 6, 5)
    s = t.insert([(2, 9.0, "late"), (7, 7.0, "new"), (3, 0.5, "now fits")])
    assert (s.accepted, s.rejected) == (4, 7)
    h = t.flush(str(tmp_path / "s"))
    assert h == t.flush(str(tmp_path / "s"))  # flushing again changes nothing
    seg = Segment.open(spark, str(tmp_path / "s"))
    assert seg.query("SELECT id, country").rows() == [(1, "a"), (2, ""), (7, "new"), (3, "now fits")]
    assert seg.query("SELECT COUNT(*)").rows() == [(4,)]
    assert seg.query("SELECT SUM(id)").rows() == [(13,)]
    assert seg.column("amount").columns == ["amount"]
    with pytest.raises(UnknownColumn):
        seg.column("nope")


@pytest.mark.parametrize("size", [50, 200, 1000, 5000])
def test_bloom_mode_is_the_sequential_pass(spark, size):
    import random

    keys = [random.Random(size).randrange(2000) * 7 for _ in range(3000)]
    f, want = BloomFilter.sized(size, 0.01), []
    for i, k in enumerate(keys):
        if key_bytes(k, "int64") not in f:
            f.add(key_bytes(k, "int64"))
            want.append(i)
    df = spark.createDataFrame([(k, 0.0, "x", i) for i, k in enumerate(keys)], SCHEMA.spark(seq=True)).repartition(5)
    got, after = dedup.bloom_pass(df, SCHEMA, BloomFilter.sized(size, 0.01))
    assert sorted(r._seq for r in got.select("_seq").collect()) == want
    assert (after.bits == f.bits).all() and after.n_added == f.n_added
    first = {keys.index(k) for k in set(keys)}
    assert set(want) <= first
    sharded = {r._seq for r in dedup.sharded_bloom(df, SCHEMA, 20_000, 1e-6, 4).select("_seq").collect()}
    assert sharded == first


def test_float_keys_are_bits(spark):
    s = Schema.of("pk:float64", "pk")
    t = Table(spark, s)
    assert t.insert([(-0.0,), (0.0,), (-0.0,), (math.nan,), (math.nan,)]).accepted == 3
    t = Table(spark, s, Options("bloom", 1000))
    assert t.insert([(-0.0,), (0.0,), (-0.0,)]).accepted == 2
    t = Table(spark, s, Options("off"))
    assert t.insert([(1.0,), (1.0,)]).accepted == 2 and t.bloom is None


def test_reload_remembers_keys_and_loses_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    t = Table(spark, SCHEMA, Options("bloom", 1000))
    t.insert([(i, 1.0, "a") for i in range(10)])
    t.flush(path)
    t = Table.load(spark, path)
    assert t.rows.count() == 0
    assert t.insert([(5, 1.0, "again"), (50, 1.0, "new")]).accepted == 1
    t.flush(path)
    seg = Segment.open(spark, path)
    assert seg.n_rows == 11 and seg.bloom.n_added == 11
    assert seg.query("SELECT id WHERE id > 8").rows() == [(9,), (50,)]
    t = Table.append_to(spark, path)
    assert t.insert([(50, 1.0, ""), (51, 1.0, "")]).accepted == 1


def test_added_rows_come_last_whatever_gaps_the_order_has(spark, tmp_path):
    path = str(tmp_path / "s")
    t = Table(spark, SCHEMA)
    parts = spark.range(0, 8, 1, 4).selectExpr("id", "1.0D AS amount", "'a' AS country", "monotonically_increasing_id() AS _seq")
    t.insert_frame(parts)
    t.flush(path)
    t = Table.append_to(spark, path)
    t.insert([(100, 1.0, "b"), (101, 1.0, "b")])
    t.insert_frame(parts.selectExpr("id + 200 AS id", "amount", "country", "_seq"))
    t.flush(path)
    want = [*range(8), 100, 101, *range(200, 208)]
    assert [r[0] for r in Segment.open(spark, path).query("SELECT id").rows()] == want
    t = Table.append_to(spark, path)
    t.insert([(9, 1.0, "c")])
    t.flush(path)
    assert [r[0] for r in Segment.open(spark, path).query("SELECT id").rows()] == [*want, 9]
    assert [c["runs"] for c in Segment.open(spark, path).column_info()] == [19, 1, 4]


def test_first_rows_are_found_without_sorting_values(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 0)], SCHEMA.spark(seq=True))
    plan = dedup.first_wins(df, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


class Cluster:
    """As much of a session without a shared folder as is asked for one."""

    conf = sparkContext = property(lambda self: self)
    master = "local-cluster[2,1,1024]"
    get = lambda self, key, default=None: default
    getConf = lambda self: self
    getCheckpointDir = lambda self: None


def test_clusters_need_a_shared_folder(spark):
    with pytest.raises(OSError, match="spark.checkpoint.dir"):
        files.scratch(Cluster(), "x")
    assert files.scratch(spark, "x") != files.scratch(spark, "x")


def test_segments_that_cannot_be_resumed(spark, tmp_path):
    path = str(tmp_path / "s")
    t = Table(spark, SCHEMA, Options("off"))
    t.insert([(1, 1.0, "a")])
    t.flush(path)
    with pytest.raises(IncompatibleSegment):
        Table.load(spark, path)
    with pytest.raises(CorruptSegment):
        read_header(spark, str(tmp_path / "none"))
    (tmp_path / "s" / "_segment.json").write_text("{}")
    for crc in (tmp_path / "s").glob(".*crc"):
        crc.unlink()
    with pytest.raises(CorruptSegment):
        read_header(spark, path)


def test_large_sums_are_checked_by_the_sidecars_bounds(spark, tmp_path):
    from tessera.errors import SumOverflow

    path = str(tmp_path / "s")
    t = Table(spark, Schema.of("id:int64,v:int64", "id"))
    t.insert([(1, (1 << 63) - 1), (2, 1), (3, -(1 << 63))])
    assert t.flush(path).bounds["v"] == 1 << 63
    with pytest.raises(SumOverflow):
        Segment.open(spark, path).query("SELECT SUM(v)")
    assert Segment.open(spark, path).query("SELECT SUM(id)").rows() == [(6,)]


def test_empty_segment(spark, tmp_path):
    t = Table(spark, SCHEMA)
    t.flush(str(tmp_path / "s"))
    seg = Segment.open(spark, str(tmp_path / "s"))
    assert seg.query("SELECT *").rows() == [] and seg.query("SELECT SUM(amount)").rows() == [(0.0,)]
    assert [c["bytes"] for c in seg.column_info()] == [0, 0, 0]


def test_generated_rows(spark):
    for n, dup, unique in [(100, 0.0, 100), (100, 0.25, 75), (10, 5.0, 1), (1, 0.5, 1), (0, 0.5, 0), (10, -1.0, 10)]:
        df = generate.rows(spark, n, dup)
        assert (df.count(), df.select("event_id").distinct().count()) == (n, unique)
    assert generate.rows(spark, 50, 0.2).exceptAll(generate.rows(spark, 50, 0.2)).isEmpty()


_ROWS = st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.floats(allow_nan=False), st.text(max_size=4)), max_size=20)


@given(_ROWS)
@settings(max_examples=30)
def test_binary_file_round_trip(rows):
    cols = [list(c) for c in zip(*rows)] if rows else [[], [], []]
    f = BloomFilter.sized(10, 0.1)
    image = columnfile.unpack(columnfile.pack(SCHEMA, cols, len(rows), f))
    assert image.schema == SCHEMA and image.n_rows == len(rows) and image.bloom.m == f.m
    assert [list(image.column(c)) for c in SCHEMA.names] == cols


def test_binary_file_versions_and_corruption(spark, tmp_path):
    import struct

    from tessera.functions import rle
    from tessera.functions.bloom import varint

    body = rle.encode_raw([1, 2, 2], "int64")
    old = struct.pack("<4sHHQ", b"UCOL", 1, 1, 3) + varint(1) + b"v" + bytes([0, 0]) + varint(len(body)) + body
    image = columnfile.unpack(old + b"trailing bytes don't matter without a filter")
    assert image.version == 1 and image.pk == "" and list(image.column("v")) == [1, 2, 2]
    raw = columnfile.pack(SCHEMA, [[1, 1], [0.5, 0.5], ["a", "b"]], 2, BloomFilter.sized(10, 0.1))
    for bad in (b"", b"XXXX" + raw[4:], raw[:4] + b"\x09" + raw[5:], raw[:16] + b"\0" + raw[17:], raw[:40], raw[:-1], raw + b"z"):
        with pytest.raises(CorruptSegment):
            columnfile.unpack(bad)
    (tmp_path / "a.bin").write_bytes(raw)
    spark.dataSource.register(columnfile.ColumnFileSource)
    rows = spark.read.format("columnfile").load(str(tmp_path / "a.bin")).collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, "a"), (1, 0.5, "b")]


def test_binary_files_are_segments_too(spark, tmp_path):
    from tessera.cli import main
    from tessera.sources.segment import export

    t = Table(spark, SCHEMA, Options("bloom", 1000))
    t.insert([(3, 0.5, "a"), (1, 1.5, "a"), (2, -0.0, "é")])
    t.flush(str(tmp_path / "s"))
    export(Segment.open(spark, str(tmp_path / "s")), str(tmp_path / "one.bin"))
    seg = Segment.open(spark, str(tmp_path / "one.bin"))
    assert seg.schema == SCHEMA and seg.bloom.n_added == 3
    assert seg.query("SELECT id, country WHERE amount < 1.0").rows() == [(3, "a"), (2, "é")]
    assert [r[0] for r in seg.column("amount").collect()] == [0.5, 1.5, -0.0] and seg.column("amount").columns == ["amount"]
    assert seg.query("SELECT COUNT(*)").rows() == [(3,)] and seg.query("SELECT SUM(id)").rows() == [(6,)]
    assert Table.load(spark, str(tmp_path / "one.bin")).insert([(1, 0.0, ""), (9, 0.0, "")]).accepted == 1
    out = []
    assert main(["inspect", str(tmp_path / "one.bin")], lambda text, end="": out.append(text), None, spark) == 0
    assert "format:  v2" in "".join(out) and "RLE" in "".join(out)
