"""Uniqueness of keys at ingest: the first row of a key wins.

``exact`` takes the least order number of each key with a map-side combine, so
that a key with a third of all rows costs one number for each task.  ``bloom`` gives the verdicts of a
filter that is asked row by row, bit for bit: rows rejected never change it, so
only first occurrences, in order, go through the one sequential pass, and only
their key hashes.  ``sharded`` runs one filter for each shard of the key space
in parallel (as many false positives, but not the same ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bloom import BloomFilter, hash128, key_matrix
from tessera.schema import FLOAT64, SEQ, Schema


def key_identity(schema: Schema) -> Column:
    """The key as it is compared: floats by their bits (-0.0 is not 0.0; NaNs are one key)."""
    pk = F.col(f"`{schema.pk}`")
    return pk.cast("string") if schema.key.type == FLOAT64 else pk


def first_wins(df: DataFrame, schema: Schema, seq: str = SEQ) -> DataFrame:
    """Of each key the row with the smallest `seq`.

    Only keys and order numbers are grouped (by hash, as a minimum of longs
    needs no sort); rows meet the winners by both, so that a hot key's rows are
    dealt out by their order numbers.
    """
    keyed = df.withColumn("_key", key_identity(schema))
    least = keyed.groupBy("_key").agg(F.min(F.col(seq).cast("long")).alias("_least")).withColumnRenamed("_key", "_won")
    return keyed.join(least, (F.col(seq) == F.col("_least")) & F.col("_key").eqNullSafe(F.col("_won")), "left_semi").drop("_key")


def unseen(df: DataFrame, schema: Schema, history: DataFrame) -> DataFrame:
    """Rows whose key isn't among the history's."""
    old = history.select(key_identity(schema).alias("_key")).distinct()
    return df.withColumn("_key", key_identity(schema)).join(old, "_key", "left_anti").drop("_key")


def hashed(df: DataFrame, schema: Schema, seq: str = SEQ) -> DataFrame:
    """(seq, high, low): the key's hash in two halves, computed in parallel."""
    kind = schema.key.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).to_pylist() if kind == "string" else b.column(1).to_numpy()
            high, low = hash128(*key_matrix(keys, kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], [seq, "high", "low"])

    return df.select(seq, F.col(f"`{schema.pk}`")).mapInArrow(run, f"{seq} long, high long, low long")


def _pass(state: bytes, seq: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = BloomFilter.from_bytes(state)
        for b in batches:
            ok = f.admit(*(b.column(i).to_numpy().view(np.uint64) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.nulls(int(ok.sum()), pa.binary())], [seq, "state"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([f.to_bytes()], pa.binary())], [seq, "state"])

    return run


def bloom_pass(df: DataFrame, schema: Schema, start: BloomFilter, seq: str = SEQ) -> tuple[DataFrame, BloomFilter]:
    """Rows that the filter admits in `seq` order, and the filter after them.

    The pass itself is one task over 24 bytes for each distinct key; its
    verdicts are persisted, as both results come from them.
    """
    first = first_wins(df, schema, seq)
    ordered = hashed(first, schema, seq).orderBy(seq).coalesce(1)
    verdicts = ordered.mapInArrow(_pass(start.to_bytes(), seq), f"{seq} long, state binary").persist()
    after = BloomFilter.from_bytes(bytes(verdicts.where(f"{seq} = -1").select("state").first()[0]))
    return first.join(verdicts.where(f"{seq} >= 0").select(seq), seq, "left_semi"), after


def sharded_bloom(df: DataFrame, schema: Schema, expected: int, rate: float, shards: int, seq: str = SEQ) -> DataFrame:
    """Rows that filters of the key's shards admit, in parallel; shards are of equal expected size."""
    first = first_wins(df, schema, seq)
    state = BloomFilter.sized(max(1, -(-expected // shards)), rate).to_bytes()
    h = hashed(first, schema, seq).withColumn("shard", F.pmod(F.xxhash64("high", "low"), F.lit(shards)))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by(seq)
        f = BloomFilter.from_bytes(state)
        ok = f.admit(*(table[c].to_numpy().view(np.uint64) for c in ("high", "low")))
        return pa.table({seq: table[seq].filter(pa.array(ok))})

    return first.join(h.groupBy("shard").applyInArrow(shard, f"{seq} long"), seq, "left_semi")


def counters(read: int, bad: int, accepted: int) -> dict[str, int]:
    return {"rows_read": read, "parse_errors": bad, "accepted": accepted, "rejected": read - bad - accepted}
