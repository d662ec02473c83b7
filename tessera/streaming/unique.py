"""Streams into unique tables: each micro-batch is made unique within itself and against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import dedup
from tessera.schema import SEQ, Schema
from tessera.sources import files, segment


def unique_sink(stream: DataFrame, schema: Schema, path: str, order: str) -> DataStreamWriter:
    """A writer that appends each batch's new keys to the segment as a part; the first by `order` wins.

    A batch that is replayed after a failure finds its own part's keys stored
    and adds nothing, so the table stays unique.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = segment.Segment.open(spark, path) if files.exists(spark, f"{path}/_segment.json") else None
        start = old.next_seq if old else 0
        rows = batch.select(*[F.col(f"`{n}`") for n in schema.names], F.col(order).alias(SEQ)).dropna()
        fresh = dedup.first_wins(rows, schema)
        if old:
            fresh = dedup.unseen(fresh, schema, old.df)
        # order within the batch, after all that is stored
        ranked = fresh.orderBy(SEQ).drop(SEQ).withColumn(SEQ, F.monotonically_increasing_id() + F.lit(start))
        segment.write(spark, path, ranked, schema, None, append=True)

    return stream.writeStream.foreachBatch(store)


def unique_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Distinct keys of a stream while its watermark remembers them; the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
