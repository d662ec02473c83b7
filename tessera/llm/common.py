"""What the corpus operators share: reading, chunking, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text worked on at once in a Python worker, in bytes; longer texts go alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir.  Only a local session may do without: there a folder of the machine is shared by all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise OSError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the deterministic fold of a row."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def blocks_for(df: DataFrame, per_block: int = 2048) -> int:
    """Number of blocks for a table: grows with its rows, so that a block stays bounded."""
    return max(1, -(-df.count() // per_block))


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of at most `limit` bytes in all (one at least)."""
    start = total = 0
    for i, x in enumerate(texts):
        if i > start and total + len(x) > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield slice(start, len(texts))


def portions(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows, so that only a few of a batch's texts are Python objects at a time."""
    for i in range(0, len(column), rows):
        texts = encoded(column.slice(i, rows))
        for s in chunks(texts, limit):
            yield i + s.start, texts[s]
