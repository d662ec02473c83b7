"""Run-length analysis in DataFrame functions, and the run codec on bytes."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CorruptRuns
from tessera.functions.bloom import read_varint, varint
from tessera.schema import FLOAT64, INT64, SEQ

#: Rows of one window partition in run analysis.
CHUNK = 1 << 20


def identity(column):
    """What makes floats one run: their bits (so -0.0 is not 0.0)."""
    return F.when(F.isnan(column), F.lit("NaN")).otherwise(column.cast("string"))


def runs(df: DataFrame, column: str, seq: str = SEQ) -> DataFrame:
    """(first, row, value, n): maximal runs of equal values in row order.

    ``first`` is the order number of a run's first row, ``row`` how many rows
    are before it: order numbers may have gaps, which don't part runs.  Chunks
    of order numbers are cut into runs independently.  What a chunk's first run
    continues is found by a pass over one row for each chunk that has rows; so
    nothing but that small table is ever in one place.
    """
    value = F.col(f"`{column}`")
    same = identity(value) if dict(df.dtypes)[column] == "double" else value
    base = df.select(F.col(seq).cast("long").alias("seq"), value.alias("value"), same.alias("key"))
    base = base.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    w = Window.partitionBy("chunk").orderBy("seq")
    fresh = F.coalesce((F.col("key") != F.lag("key").over(w)).cast("int"), F.lit(1))
    part = base.withColumns({"run": F.sum(fresh).over(w), "place": F.row_number().over(w).cast("long") - 1}).groupBy("chunk", "run")
    part = part.agg(F.min("seq").alias("first"), F.min("place").alias("place"), F.min_by("value", "seq").alias("value"), F.min_by("key", "seq").alias("key"), F.count("*").alias("n"))
    # a chunk in one row: its rows and runs, the keys at its ends
    chunks = part.groupBy("chunk").agg(F.max("run").alias("runs"), F.sum("n").alias("rows"), F.min_by("key", "run").alias("head"), F.max_by("key", "run").alias("tail"), F.min_by("n", "run").alias("length"))
    order = Window.orderBy("chunk")
    chunks = chunks.withColumns({"before": F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "continues": F.coalesce(F.lag("tail").over(order) == F.col("head"), F.lit(False))})
    # where the run at a chunk's end began: here, unless the chunk is all of one run that goes on
    here = F.when(~F.col("continues") | (F.col("runs") > 1), F.struct(F.col("chunk").alias("chunk"), F.col("runs").alias("run")))
    chunks = chunks.withColumn("owner", F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    more = chunks.where("continues").groupBy("owner.chunk", "owner.run").agg(F.sum("length").alias("more"))
    whole = part.join(chunks.select("chunk", "before", "continues"), "chunk").where("not (continues and run = 1)").join(more, ["chunk", "run"], "left")
    return whole.select("first", (F.col("before") + F.col("place")).alias("row"), "value", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def expanded(table: DataFrame, row: str = "row") -> DataFrame:
    """The rows that runs stand for: (row, value), rows counted from 0 whatever gaps their order has."""
    return table.select(F.explode(F.sequence(F.col("row"), F.col("row") + F.col("n") - 1)).alias(row), "value")


def _varint_size(n):
    return F.greatest(F.lit(1), F.ceil((F.floor(F.log2(n.cast("double"))) + 1) / 7)).cast("long")


def sizes(df: DataFrame, column: str, seq: str = SEQ) -> DataFrame:
    """One row: rows, runs, raw_bytes and rle_bytes of a column under the run codec."""
    text = dict(df.dtypes)[column] == "string"
    width = F.octet_length("value").cast("long") if text else F.lit(8).cast("long")
    one = width + _varint_size(F.greatest(width, F.lit(1))) if text else width
    r = runs(df, column, seq)
    return r.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count("*").alias("runs"),
        F.coalesce(F.sum((width + (4 if text else 0)) * F.col("n")), F.lit(0)).cast("long").alias("raw_bytes"),
        F.coalesce(F.sum(one + _varint_size(F.col("n"))), F.lit(0)).cast("long").alias("rle_bytes"),
    )


# -- the codec on bytes -------------------------------------------------


def encode(values, kind: str) -> bytes:
    """[count varint][value] for each run."""
    if not len(values):
        return b""
    if kind in (INT64, FLOAT64):
        x = np.ascontiguousarray(values, "<i8" if kind == INT64 else "<f8")
        bits = x.view(np.int64)
        at = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
        counts = np.diff(np.append(at, len(x))).tolist()
        raw = x[at].tobytes()
        return b"".join(varint(n) + raw[8 * i : 8 * i + 8] for i, n in enumerate(counts))
    out, last, n = [], values[0], 0
    for v in [*values, None]:
        if v == last:
            n += 1
            continue
        raw = last.encode()
        out.append(varint(n) + varint(len(raw)) + raw)
        last, n = v, 1
    return b"".join(out)


def decode(raw: bytes, kind: str, rows: int) -> np.ndarray | list[str]:
    """All values; raises CorruptRuns unless the runs make up exactly `rows` of them."""
    counts, values, at, total = [], [], 0, 0
    while at < len(raw):
        n, at = read_varint(raw, at, CorruptRuns)
        size = 8
        if kind not in (INT64, FLOAT64):
            size, at = read_varint(raw, at, CorruptRuns)
        if at + size > len(raw) or not n or total + n > rows:
            raise CorruptRuns(f"run of {n} at byte {at}")
        counts.append(n)
        values.append(raw[at : at + size])
        at, total = at + size, total + n
    if total != rows:
        raise CorruptRuns(f"{total} rows, {rows} told")
    if kind in (INT64, FLOAT64):
        return np.repeat(np.frombuffer(b"".join(values), "<i8" if kind == INT64 else "<f8"), counts)
    return [t for v, n in zip(values, counts) for t in [v.decode()] * n]


def encode_raw(values, kind: str) -> bytes:
    if kind in (INT64, FLOAT64):
        return np.ascontiguousarray(values, "<i8" if kind == INT64 else "<f8").tobytes()
    return b"".join(varint(len(r)) + r for r in (v.encode() for v in values))


def decode_raw(raw: bytes, kind: str, rows: int) -> np.ndarray | list[str]:
    if kind in (INT64, FLOAT64):
        if len(raw) != 8 * rows:
            raise CorruptRuns(f"{len(raw)} bytes for {rows} rows")
        return np.frombuffer(raw, "<i8" if kind == INT64 else "<f8")
    out, at = [], 0
    for _ in range(rows):
        n, at = read_varint(raw, at, CorruptRuns)
        if at + n > len(raw):
            raise CorruptRuns("string past the end")
        out.append(raw[at : at + n].decode())
        at += n
    if at != len(raw):
        raise CorruptRuns("bytes left over")
    return out


