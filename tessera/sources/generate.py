"""Deterministic rows for benchmarks: unique keys first, then an exact number of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import FLOAT64, INT64, SEQ, STRING, Schema

#: The countries rows are drawn from.
COUNTRIES = [f"C{i:02d}" for i in range(20)]
BENCH_SCHEMA = Schema.of([("event_id", INT64), ("user_id", INT64), ("amount", FLOAT64), ("country", STRING)], "event_id")


def round2(x):
    """Half away from zero, to two places."""
    return F.round(x, 2)


def rows(spark: SparkSession, n: int, dup_fraction: float = 0.0, seed: int = 42) -> DataFrame:
    """n rows in order of SEQ: keys 1 to u, then floor(dup_fraction * n) rows (all but one at most) with keys of those."""
    if n <= 0:
        return spark.createDataFrame([], BENCH_SCHEMA.spark(seq=True))
    dups = min(n - 1, int(max(0.0, dup_fraction) * n))
    unique = n - dups
    pick = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size))
    key = F.when(F.col("id") < unique, F.col("id") + 1).otherwise(pick(1, unique) + 1)
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (pick(4, len(COUNTRIES)) + 1).cast("int"))
    return spark.range(n).select(
        key.alias("event_id"),
        (pick(2, 100_000) + 1).alias("user_id"),
        round2(pick(3, 100_001) / F.lit(100.0)).alias("amount"),
        country.alias("country"),
        F.col("id").alias(SEQ),
    )
