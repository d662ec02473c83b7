"""int64 sums that must not leave their range after any row, in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import SumOverflow

LARGEST = (1 << 63) - 1
#: Rows of one window partition of the exact check.
CHUNK = 1 << 20
_WIDE = "decimal(38,0)"


def check_prefixes(df: DataFrame, column: str, seq: str, group: str | None = None) -> None:
    """Raise SumOverflow if the running sum of any group leaves int64.

    First by a bound that one aggregation gives: while the absolute values' sum
    is in range, so is every prefix.  Only groups beyond it are run through,
    chunk by chunk: each chunk's total and extreme prefixes, then the running
    totals over the chunks, which are few.
    """
    x = F.col(f"`{column}`").cast(_WIDE)
    g = F.col(f"`{group}`") if group else F.lit(1)
    base = df.select(g.alias("g"), x.alias("x"), F.col(seq).cast("long").alias("s"))
    wide = base.groupBy("g").agg(F.sum(F.abs("x")).alias("a")).where(F.col("a") > F.lit(LARGEST).cast(_WIDE))
    if wide.isEmpty():
        return
    rows = base.join(wide.select("g"), "g", "left_semi").withColumn("c", F.floor(F.col("s") / CHUNK))
    running = rows.withColumn("p", F.sum("x").over(Window.partitionBy("g", "c").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    chunks = running.groupBy("g", "c").agg(F.sum("x").alias("t"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.min("s").alias("s"))
    before = Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ends = chunks.withColumn("o", F.coalesce(F.sum("t").over(before), F.lit(0).cast(_WIDE)))
    out = (F.col("o") + F.col("hi") > F.lit(LARGEST).cast(_WIDE)) | (F.col("o") + F.col("lo") < F.lit(-LARGEST - 1).cast(_WIDE))
    bad = ends.where(out).orderBy("s").select("g").first()
    if bad is not None:
        raise SumOverflow(column, bad[0], grouped=group is not None)


def total(column: str, kind: str):
    """The sum as an aggregate column: zero over no rows.  Over int64 it is added up in decimals, whatever the order."""
    x = F.col(f"`{column}`")
    if kind == "int64":
        return F.coalesce(F.sum(x.cast("decimal(28,0)")).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(F.sum(x), F.lit(0.0))
