import math

import pytest

from tessera.errors import SumOverflow, TypeMismatch, UnknownColumn
from tessera.plans.execute import Source, execute
from tessera.plans.queries import ORACLE, QUERIES

TOP = (1 << 63) - 1


@pytest.fixture(scope="module")
def moorings(spark):
    rows = [(11, 2.5, "pier"), (14, 7.25, "dock"), (12, 4.0, "pier"), (19, 0.5, "quay"), (13, 9.75, "dock"), (16, 6.0, "pier")]
    return Source.of(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "code long, level double, site string, _seq long").repartition(3))


CASES = {
    "SELECT code WHERE site = 'pier' AND level > 3.0": [(12,), (16,)],
    "SELECT code WHERE site = 'quay' OR level >= 7.25": [(14,), (19,), (13,)],
    "SELECT code WHERE level < 1.0 OR site = 'dock' AND code > 13": [(14,), (19,)],
    "SELECT site WHERE site > 'pier'": [("quay",)],
    "SELECT code, site WHERE code <= 12": [(11, "pier"), (12, "pier")],
    "SELECT code WHERE level != 4.0 AND site != 'dock'": [(11,), (19,), (16,)],
    "SELECT level, code, level WHERE code = 19": [(0.5, 19, 0.5)],
    "SELECT * WHERE code >= 19": [(19, 0.5, "quay")],
    "SELECT COUNT(*)": [(6,)],
    "SELECT COUNT(*) WHERE level < 5.0": [(3,)],
    "SELECT SUM(level)": [(30.0,)],
    "SELECT SUM(code)": [(85,)],
    "SELECT SUM(code) WHERE site = 'dock'": [(27,)],
    "SELECT SUM(level) WHERE code < 0": [(0.0,)],
    "SELECT SUM(code) WHERE level > 100.0": [(0,)],
    "SELECT site, COUNT(*) WHERE code > 20 GROUP BY site": [],
    "SELECT site, COUNT(*) GROUP BY site": [("pier", 3), ("dock", 2), ("quay", 1)],
    "SELECT site, SUM(level) GROUP BY site": [("pier", 12.5), ("dock", 17.0), ("quay", 0.5)],
    "SELECT site, SUM(code) WHERE level > 3.0 GROUP BY site": [("dock", 27), ("pier", 28)],
    "SELECT code, SUM(code) WHERE code < 13 GROUP BY code": [(11, 11), (12, 12)],
    "SELECT level, COUNT(*) WHERE code > 15 GROUP BY level": [(0.5, 1), (6.0, 1)],
}


@pytest.mark.parametrize("sql", CASES)
def test_results_in_order(moorings, sql):
    assert execute(moorings, sql).rows() == CASES[sql]


ERRORS = {
    "SELECT site WHERE level >= 7": (TypeMismatch, 'position 18: column "level"'),
    "SELECT site WHERE level > 7.0 OR code < 'ten'": (TypeMismatch, 'position 33: column "code"'),
    "SELECT SUM(site)": (TypeMismatch, "type mismatch"),
    "SELECT code, SUM(site) GROUP BY code": (TypeMismatch, "type mismatch"),
    "SELECT code, depth": (UnknownColumn, "(projection)"),
    "SELECT SUM(depth) WHERE width = 1": (UnknownColumn, '"depth" (projection)'),
    "SELECT code WHERE depth = 1 AND code = 'x'": (UnknownColumn, "in WHERE"),
    "SELECT depth, COUNT(*) GROUP BY depth": (UnknownColumn, "in GROUP BY"),
    "SELECT site, SUM(depth) GROUP BY site": (UnknownColumn, "in SUM"),
    "SELECT Site": (UnknownColumn, '"Site"'),
}


@pytest.mark.parametrize("sql", ERRORS)
def test_errors(moorings, sql):
    kind, message = ERRORS[sql]
    with pytest.raises(kind) as e:
        execute(moorings, sql)
    assert message in str(e.value)


@pytest.mark.parametrize("values, ok", [([TOP, 1, -1], False), ([1, -1, TOP], True), ([TOP - 1, TOP - 1], False), ([-TOP - 1, -1, 5], False), ([-TOP - 1], True), ([], True)])
def test_overflow_is_by_prefix(spark, values, ok):
    df = spark.createDataFrame([(v, "g", i) for i, v in enumerate(values)], "v long, g string, _seq long").repartition(2)
    for sql in ("SELECT SUM(v)", "SELECT g, SUM(v) GROUP BY g"):
        if ok:
            assert [r[-1] for r in execute(Source.of(df), sql).rows()] in ([sum(values)], [] if "g," in sql else [0])
        else:
            with pytest.raises(SumOverflow) as e:
                execute(Source.of(df), sql)
            assert ("in group g" in str(e.value)) == ("GROUP" in sql)


def test_overflow_names_the_group(spark):
    df = spark.createDataFrame([(TOP - 1, "a", 0), (TOP - 1, "a", 1), (5, "b", 2)], "v long, g string, _seq long")
    with pytest.raises(SumOverflow, match="in group a"):
        execute(Source.of(df), "SELECT g, SUM(v) GROUP BY g")


@pytest.mark.parametrize(
    "ids, beyond",
    [([922], []), ([923], [10**16]), ([922, None, 1], [10**16]), ([-900, 1000], []), ([1000, -900], [10**16]), ([TOP], [10**12, 10**15, 10**16]), ([TOP, 1], [1, 10**12, 10**15, 10**16]), ([], [])],
)
def test_products_beyond_int64(spark, tmp_path, ids, beyond):
    """Products that don't fit are no error: what counts is the sum after each row."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, v) for i, v in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long").repartition(2).write.parquet(path := f"{tmp_path}/events.parquet")
    got = {r.factor: r.overflows for r in QUERIES["sum_overflow"](spark, str(tmp_path)).collect()}
    assert [f for f in got if got[f]] == beyond
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        assert got == dict(con.execute(ORACLE["sum_overflow"]).fetchall())


def test_nan_and_zero(spark):
    values = [math.nan, -math.inf, -0.0, 0.0, 1.5, math.inf]
    src = Source.of(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "f double, _seq long"))
    count = lambda op: len(execute(src, f"SELECT f WHERE f {op} 1.0").rows())
    assert {op: count(op) for op in ("=", "!=", "<", ">", "<=", ">=")} == {"=": 0, "!=": 6, "<": 3, ">": 2, "<=": 3, ">=": 2}
    assert [r[1] for r in execute(src, "SELECT f, COUNT(*) GROUP BY f").rows()] == [1, 1, 2, 1, 1]


def test_pushdown_and_pruning(spark, sf):
    src = Source.of(spark.read.parquet(f"{sf}/events.parquet"), "event_id")
    plan = execute(src, "SELECT value WHERE event_type = 'click'").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan
    assert "props" not in plan
