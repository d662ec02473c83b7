"""Registered queries of the engine and their SQL twins, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SumOverflow
from tessera.functions import rle
from tessera.functions.bloom import BloomFilter
from tessera.operators import dedup
from tessera.operators.table import Options, Table
from tessera.plans.execute import Source, execute
from tessera.schema import INT64, Schema
from tessera.sources import csv, files, generate
from tessera.sources.segment import Segment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_WIDE = ("int",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its ints widened to the engine's int64."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("long").alias(c) if t in _WIDE else F.col(c) for c, t in df.dtypes])


def _register(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _statement(name: str, of: str, sql: str, oracle: str, rename: dict[str, str] | None = None, rounded: str | None = None, discovery: bool = False) -> None:
    """A statement of the dialect; a twin's names are SQL-safe, floating sums are rounded on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "region": "r_regionkey"}.get(of)
        df = table(spark, sf_dir, of)
        if key is None:  # no single key column: the order of its rows in the file
            meta = F.col("_metadata.row_index")
            raw = spark.read.parquet(f"{sf_dir}/{of}.parquet")
            df = raw.select(*[F.col(c).cast("long").alias(c) if t in _WIDE else F.col(c) for c, t in raw.dtypes], meta.alias("_seq"))
            key = "_seq"
        got = execute(Source.of(df, key), sql)
        out = got.df.withColumnRenamed("_order", "first_seen") if discovery else got.df.drop("_order")
        for old, new in (rename or {}).items():
            out = out.withColumnRenamed(old, new)
        return out.withColumn(rounded, F.round(rounded, 2)) if rounded else out

    _register(name, oracle)(run)


_E = "FROM events"
for _name, _where in {
    "filter_eq_str": "event_type = 'click'",
    "filter_neq_str": "event_type != 'click'",
    "filter_lt_str": "event_type < 'login'",
    "filter_gte_str": "event_type >= 'login'",
    "filter_eq_int": "user_id = 7",
    "filter_neq_int": "user_id != 7",
    "filter_lt_int": "user_id < 50",
    "filter_gt_int": "user_id > 50",
    "filter_lte_int": "user_id <= 50",
    "filter_gte_int": "user_id >= 50",
    "filter_eq_float": "value = 100.0",
    "filter_gt_float": "value > 100.0",
    "filter_lte_float": "value <= 12.5",
    "filter_and": "event_type = 'click' AND value > 50.0",
    "filter_or": "event_type = 'click' OR value < 5.0",
    "filter_precedence": "event_type = 'click' AND value > 50.0 OR user_id = 3",
    "filter_or_and_or": "user_id = 3 OR event_type = 'click' AND value > 50.0 OR user_id = 9",
    "filter_same_col_range": "value >= 20.0 AND value < 40.0",
    "filter_negative": "value > -1.0 AND user_id > -5",
}.items():
    _statement(_name, "events", f"SELECT event_id, user_id, value WHERE {_where}", f"SELECT event_id, user_id, value {_E} WHERE {_where}")
_statement("project_columns", "events", "SELECT event_id, value", f"SELECT event_id, value {_E}")
_statement("project_star", "region", "SELECT *", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
_statement("project_reordered", "part", "SELECT p_name, p_partkey, p_size", "SELECT p_name, p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
_statement("count_star", "events", "SELECT COUNT(*)", f"SELECT count(*) AS cnt {_E}", {"COUNT(*)": "cnt"})
_statement("count_filtered", "events", "SELECT COUNT(*) WHERE value > 50.0", f"SELECT count(*) AS cnt {_E} WHERE value > 50.0", {"COUNT(*)": "cnt"})
_statement("count_none", "events", "SELECT COUNT(*) WHERE value < 0.0", f"SELECT count(*) AS cnt {_E} WHERE value < 0.0", {"COUNT(*)": "cnt"})
_statement("sum_int", "events", "SELECT SUM(user_id)", f"SELECT CAST(coalesce(sum(user_id), 0) AS BIGINT) AS total {_E}", {"SUM(user_id)": "total"})
_statement("sum_float", "events", "SELECT SUM(value)", f"SELECT round(sum(value), 2) AS total {_E}", {"SUM(value)": "total"}, "total")
_statement("sum_filtered", "lineitem", "SELECT SUM(l_extendedprice) WHERE l_quantity > 25.0 AND l_returnflag = 'R'", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 25.0 AND l_returnflag = 'R'", {"SUM(l_extendedprice)": "total"}, "total")
_statement("sum_empty", "events", "SELECT SUM(user_id) WHERE value < 0.0", f"SELECT CAST(coalesce(sum(user_id), 0) AS BIGINT) AS total {_E} WHERE value < 0.0", {"SUM(user_id)": "total"})
_statement("group_count", "events", "SELECT event_type, COUNT(*) GROUP BY event_type", f"SELECT event_type, count(*) AS cnt {_E} GROUP BY 1", {"COUNT(*)": "cnt"})
_statement("group_filtered", "events", "SELECT event_type, COUNT(*) WHERE value > 50.0 GROUP BY event_type", f"SELECT event_type, count(*) AS cnt {_E} WHERE value > 50.0 GROUP BY 1", {"COUNT(*)": "cnt"})
_statement("group_none", "events", "SELECT event_type, COUNT(*) WHERE value < 0.0 GROUP BY event_type", f"SELECT event_type, count(*) AS cnt {_E} WHERE value < 0.0 GROUP BY 1", {"COUNT(*)": "cnt"})
_statement("group_sum_float", "events", "SELECT event_type, SUM(value) GROUP BY event_type", f"SELECT event_type, round(sum(value), 2) AS total {_E} GROUP BY 1", {"SUM(value)": "total"}, "total")
_statement("group_sum_int", "events", "SELECT event_type, SUM(user_id) GROUP BY event_type", f"SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total {_E} GROUP BY 1", {"SUM(user_id)": "total"})
_statement("group_sum_same", "events", "SELECT user_id, SUM(user_id) GROUP BY user_id", f"SELECT user_id AS k, CAST(sum(user_id) AS BIGINT) AS total {_E} GROUP BY 1", {"SUM(user_id)": "total", "user_id": "k"})
_statement("group_int_key", "events", "SELECT user_id, COUNT(*) GROUP BY user_id", f"SELECT user_id, count(*) AS cnt {_E} GROUP BY 1", {"COUNT(*)": "cnt"})
_statement("group_float_key", "lineitem", "SELECT l_discount, COUNT(*) GROUP BY l_discount", "SELECT l_discount, count(*) AS cnt FROM lineitem GROUP BY 1", {"COUNT(*)": "cnt"})
_statement("group_discovery_order", "events", "SELECT event_type, COUNT(*) GROUP BY event_type", f"SELECT event_type, count(*) AS cnt, min(event_id) AS first_seen {_E} GROUP BY 1", {"COUNT(*)": "cnt"}, None, True)

_USERS = Schema.of("event_id:int64,user_id:int64,value:float64,event_type:string", "user_id")
_ORDERS = Schema.of("o_orderkey:int64,o_custkey:int64,o_totalprice:float64,o_orderpriority:string", "o_custkey")
_TYPES = Schema.of("event_id:int64,user_id:int64,value:float64,event_type:string", "event_type")


def _keyed(spark: SparkSession, sf_dir: str, name: str, schema: Schema, seq: str) -> DataFrame:
    return table(spark, sf_dir, name).select(*schema.names, F.col(seq).alias("_seq"))


def _first(cols: str, of: str, pk: str, seq: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {pk} ORDER BY {seq}) AS rn FROM {of}) WHERE rn = 1"


@_register("dedup_exact", _first("event_id, user_id, value, event_type", "events", "user_id", "event_id"))
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_keyed(spark, sf_dir, "events", _USERS, "event_id"), _USERS).drop("_seq")


@_register("dedup_orders_per_customer", _first("o_orderkey, o_custkey, o_totalprice, o_orderpriority", "orders", "o_custkey", "o_orderkey"))
def dedup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_keyed(spark, sf_dir, "orders", _ORDERS, "o_orderkey"), _ORDERS).drop("_seq")


@_register("dedup_string_pk", _first("event_id, user_id, value, event_type", "events", "event_type", "event_id"))
def dedup_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_keyed(spark, sf_dir, "events", _TYPES, "event_id"), _TYPES).drop("_seq")


@_register("dedup_stats", "SELECT count(DISTINCT user_id) AS accepted, count(*) - count(DISTINCT user_id) AS rejected, count(*) AS rows_read FROM events")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(spark, _USERS, Options("exact"))
    stats = t.insert_frame(_keyed(spark, sf_dir, "events", _USERS, "event_id"))
    t.rows.unpersist()
    return spark.createDataFrame([(stats.accepted, stats.rejected, stats.accepted + stats.rejected)], "accepted long, rejected long, rows_read long")


@_register(
    "dedup_cross_session",
    "WITH cut AS (SELECT max(event_id) / 100 AS c FROM events), new AS (SELECT * FROM events, cut WHERE event_id >= c) "
    "SELECT event_id, user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM new "
    "WHERE user_id NOT IN (SELECT user_id FROM events, cut WHERE event_id < c)) WHERE rn = 1",
)
def dedup_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first session stores the first hundredth of the ids, a second one offers the rest."""
    rows = _keyed(spark, sf_dir, "events", _USERS, "event_id")
    cut = rows.agg(F.max("event_id") / 100).first()[0] or 0
    return dedup.unseen(dedup.first_wins(rows.where(F.col("event_id") >= cut), _USERS), _USERS, rows.where(F.col("event_id") < cut)).drop("_seq")


@_register("dedup_bloom", _first("event_id, user_id, value, event_type", "events", "user_id", "event_id"))
def dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a filter of a million keys at a rate of 1e-4 no key here is a false positive (tests assert it), so the exact twin holds."""
    rows = _keyed(spark, sf_dir, "events", _USERS, "event_id")
    return dedup.bloom_pass(rows, _USERS, BloomFilter.sized(1_000_000, 1e-4))[0].drop("_seq")


_SIZES = [(1_000, 0.01), (100_000, 0.01), (100_000, 0.001), (1_000_000, 0.01), (1_000_000, 0.001), (50_000_000, 0.05)]


@_register(
    "bloom_sizing",
    "SELECT n, p, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m, CAST(greatest(1, least(30, round(ceil(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2)))) AS BIGINT) AS k FROM (VALUES "
    + ", ".join(f"(CAST({n} AS BIGINT), CAST({p} AS DOUBLE))" for n, p in _SIZES)
    + ") t(n, p)",
)
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(n, p, BloomFilter.sized(n, p)) for n, p in _SIZES]
    return spark.createDataFrame([(n, p, f.m, f.k) for n, p, f in made], "n long, p double, m long, k long")


@_register(
    "bloom_est_fpr",
    "SELECT user_id, round(pow(1 - exp(-7.0 * count(*) / 9585.0), 7), 10) AS rate FROM events GROUP BY 1",
)
def bloom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate of a filter of 9585 bits and 7 hashes that had each user's events added."""

    def run(batches):
        for b in batches:
            rates = [BloomFilter(9585, 7, np.empty(0, np.uint8), n).estimated_rate for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rates, pa.float64())], ["user_id", "rate"])

    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return per.mapInArrow(run, "user_id long, rate double").select("user_id", F.round("rate", 10).alias("rate"))


_RUNS = (
    "WITH a AS (SELECT event_id, {c} AS v, CASE WHEN lag({c}) OVER (ORDER BY event_id) = {c} THEN 0 ELSE 1 END AS f FROM events), "
    "b AS (SELECT *, sum(f) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM a) "
)


@_register("rle_runs", _RUNS.format(c="event_type") + "SELECT min(event_id) AS first_id, min(v) AS value, count(*) AS n FROM b GROUP BY r")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.runs(table(spark, sf_dir, "events"), "event_type", "event_id").select(F.col("first").alias("first_id"), "value", "n")


@_register("rle_roundtrip", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, event_type AS value FROM events")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.expanded(rle.runs(table(spark, sf_dir, "events"), "event_type", "event_id"))


@_register("rle_runs_gapped", _RUNS.format(c="event_type") + "SELECT min(event_id) * 3000000 AS first_id, CAST(min(event_id) - (SELECT min(event_id) FROM events) AS BIGINT) AS row, min(v) AS value, count(*) AS n FROM b GROUP BY r")
def rle_runs_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With so large gaps in the order that no two rows are in one chunk."""
    df = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 3_000_000).alias("event_id"))
    return rle.runs(df, "event_type", "event_id").select(F.col("first").alias("first_id"), "row", "value", "n")


@_register(
    "rle_ratio",
    _RUNS.format(c="event_type") + ", c AS (SELECT min(v) AS v, count(*) AS n FROM b GROUP BY r) "
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS runs, CAST(sum((strlen(v) + 4) * n) AS BIGINT) AS raw_bytes, "
    "CAST(sum(strlen(v) + 1 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS rle_bytes FROM c",
)
def rle_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.sizes(table(spark, sf_dir, "events"), "event_type", "event_id")


@_register(
    "bad_rows",
    "SELECT doc_id, place, coalesce(CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END, -1) AS value FROM ("
    "SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS place, unnest(ws) AS t FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents) "
    "UNION ALL SELECT event_id, -1, CAST(user_id AS VARCHAR) FROM events)",
)
def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict casts of all words and of numbers as text; -1 stands for a bad field."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "t"))
    both = words.unionAll(table(spark, sf_dir, "events").select("event_id", F.lit(-1), F.col("user_id").cast("string")))
    return both.select("doc_id", "place", F.coalesce(csv.strict(F.col("t"), "int64"), F.lit(-1)).alias("value"))


def _ingested(spark: SparkSession, sf_dir: str) -> csv.Loaded:
    """The events written as CSV, where the value of an error is no number, and read again."""
    path = files.scratch(spark, "events-csv")
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    table(spark, sf_dir, "events").select("event_id", "user_id", value.alias("value"), "event_type").coalesce(1).write.option("header", True).csv(path)
    part = next(p for p in files.children(spark, path) if p.endswith(".csv"))
    return csv.read(spark, part, Schema.of("event_type:string,event_id:int64,value:float64,user_id:int64", "event_id"), multiline=False)


@_register("csv_ingest", "SELECT event_type, event_id, value, user_id FROM events WHERE event_type <> 'error'")
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).good.drop("_seq")


@_register("csv_bad_rows", """SELECT 'column "value": cannot parse "n/a" as float64' AS reason, count(*) AS n FROM events WHERE event_type = 'error' HAVING count(*) > 0""")
def csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).bad.groupBy("reason").agg(F.count("*").alias("n"))


_FACTORS = [1, 10**12, 10**15, 10**16]


@_register(
    "sum_overflow",
    " UNION ALL ".join(f"SELECT CAST({f} AS BIGINT) AS factor, coalesce(max(p) > 9223372036854775807, false) AS overflows FROM (SELECT sum(CAST(user_id AS HUGEINT) * {f}) OVER (ORDER BY event_id) AS p FROM events)" for f in _FACTORS),
)
def sum_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a SUM of the users' ids times a factor leaves int64 after any row.

    A single product may leave it too, so products are decimals of 37 digits,
    which hold any int64 times any of the factors.
    """
    out = []
    for f in _FACTORS:
        big = F.col("user_id").cast("decimal(19,0)") * F.lit(f).cast("decimal(17,0)")
        df = table(spark, sf_dir, "events").select("event_id", big.alias("big"))
        try:
            execute(Source(df, {"big": INT64}, "event_id"), "SELECT SUM(big)")
            out.append((f, False))
        except SumOverflow:
            out.append((f, True))
    return spark.createDataFrame(out, "factor long, overflows boolean")


@_register("filter_nan", "SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def filter_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, here for each discount of zero, is above nothing."""
    d = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", d.alias("d"), F.col("_metadata.row_index").alias("_seq"))
    return execute(Source.of(df, "_seq"), "SELECT l_returnflag, COUNT(*) WHERE d > 0.05 GROUP BY l_returnflag").df.drop("_order").withColumnRenamed("COUNT(*)", "cnt")


@_register("dedup_sharded", _first("event_id, user_id, value, event_type", "events", "user_id", "event_id"))
def dedup_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each of eight shards, of a million keys at a rate of 1e-6: none of the keys here is a false positive."""
    return dedup.sharded_bloom(_keyed(spark, sf_dir, "events", _USERS, "event_id"), _USERS, 1_000_000, 1e-6, 8).drop("_seq")


@_register(
    "resume_append",
    "SELECT row_number() OVER (ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id) - 1 AS row, event_id FROM events",
)
def resume_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first session stores the clicks; a second one is offered all events, whose order numbers begin anew, and adds the rest behind them."""
    path = files.scratch(spark, "segment")
    schema = Schema.of("event_id:int64,user_id:int64,value:float64,event_type:string", "event_id")
    rows = _keyed(spark, sf_dir, "events", schema, "event_id")
    for t, offered in ((lambda: Table(spark, schema, Options("exact")), rows.where("event_type = 'click'")), (lambda: Table.append_to(spark, path), rows)):
        session = t()
        session.insert_frame(offered)
        session.flush(path)
        session.rows.unpersist()
    return rle.runs(Segment.open(spark, path).df, "event_id").select("row", F.col("value").alias("event_id"))


@_register(
    "synthetic_rows",
    "SELECT CAST(10000 AS BIGINT) AS n_rows, CAST(9000 AS BIGINT) AS n_keys, CAST(sum(i) AS BIGINT) AS sum_of_first, CAST(1000 AS BIGINT) AS repeated, CAST(20 AS BIGINT) AS countries, "
    "true AS amounts_rounded, true AS in_range FROM range(1, 9001) t(i)",
)
def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fixed about 10,000 generated rows of which a tenth repeats keys."""
    rows = generate.rows(spark, 10_000, 0.1)
    first = F.col("_seq") < 9000
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("event_id").alias("n_keys"),
        F.sum(F.when(first, F.col("event_id"))).alias("sum_of_first"),
        F.sum(F.when(~first & F.col("event_id").between(1, 9000), 1)).alias("repeated"),
        F.countDistinct("country").alias("countries"),
        F.every(F.col("amount") == F.round("amount", 2)).alias("amounts_rounded"),
        F.every(F.col("user_id").between(1, 100_000) & F.col("amount").between(0, 1000)).alias("in_range"),
    )


@_register("segment_roundtrip", "SELECT event_id, user_id, value, event_type FROM events")
def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).df.drop("_seq")


def _info_sql(column: str, kind: str) -> str:
    """A column's sizes by its runs: text in bytes with a length before it, a number in eight; each with the run's length before it."""
    one, raw = ("strlen(v) + CASE WHEN strlen(v) < 128 THEN 1 ELSE 2 END", "strlen(v) + 4") if kind == "string" else ("8", "8")
    return (
        f"SELECT '{column}' AS name, '{kind}' AS type, 'rle' AS encoding, CAST(sum({one} + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS bytes, "
        f"CAST(sum(({raw}) * n) AS BIGINT) AS raw_bytes, count(*) AS runs FROM (SELECT min(v) AS v, count(*) AS n FROM (SELECT v, sum(f) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM ("
        f"SELECT event_id, {column} AS v, CASE WHEN lag({column}) OVER (ORDER BY event_id) = {column} THEN 0 ELSE 1 END AS f FROM events)) GROUP BY r)"
    )


@_register("column_info", " UNION ALL ".join(_info_sql(c, k) for c, k in (("event_id", "int64"), ("user_id", "int64"), ("value", "float64"), ("event_type", "string"))))
def column_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _stored(spark, sf_dir).column_info()
    return spark.createDataFrame([tuple(i.values()) for i in info], "name string, type string, encoding string, bytes long, raw_bytes long, runs long")


def _stored(spark: SparkSession, sf_dir: str) -> Segment:
    """The events table ingested as a segment with a key, in the folder that the session shares."""
    path = files.scratch(spark, "segment")
    schema = Schema.of("event_id:int64,user_id:int64,value:float64,event_type:string", "event_id")
    t = Table(spark, schema, Options("exact"))
    t.insert_frame(_keyed(spark, sf_dir, "events", schema, "event_id"))
    t.flush(path)
    t.rows.unpersist()
    return Segment.open(spark, path)
