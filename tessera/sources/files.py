"""Small files and folders through Hadoop's file systems, so that any path Spark reads works."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def head(spark: SparkSession, path: str, size: int) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write beside the place, then rename: a reader sees the old file or the new one."""
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(data))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't rename {beside} to {p}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session shares, gone when the driver ends.

    Without such a folder a local session uses its machine's; on a cluster
    that is an error, as executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise OSError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.gettempdir()
    path = f"{shared}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            delete(spark, path)

    atexit.register(gone)
    return path
