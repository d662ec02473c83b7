"""Segments: a folder of Parquet parts with a sidecar of metadata.

``<path>/data/part-N`` holds rows with their order in a hidden column;
``<path>/_segment.json`` the schema, key, counts and bounds of int columns;
``<path>/_bloom`` the filter, where there is one.  Everything that needs no
rows (header, inspection, unfiltered counts) reads the sidecar only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CorruptSegment, IncompatibleSegment
from tessera.functions import rle
from tessera.functions.bloom import BloomFilter
from tessera.plans.execute import Result, Source, execute
from tessera.plans.statement import Statement
from tessera.schema import INT64, SEQ, Column, Schema
from tessera.sources import columnfile, files

VERSION = 2


@dataclass(frozen=True)
class Header:
    schema: Schema
    n_rows: int
    version: int = VERSION
    has_bloom: bool = False
    parts: int = 0
    bounds: dict[str, int] = field(default_factory=dict)
    #: Where the order of rows added later begins: beyond all order numbers that there are, which may have gaps.
    next_seq: int = 0

    def to_json(self) -> bytes:
        columns = [[c.name, c.type] for c in self.schema.columns]
        return json.dumps({"version": self.version, "pk": self.schema.pk, "columns": columns, "rows": self.n_rows, "bloom": self.has_bloom, "parts": self.parts, "bounds": self.bounds, "next": self.next_seq}).encode()

    @classmethod
    def from_json(cls, raw: bytes) -> Header:
        try:
            d = json.loads(raw)
            columns = tuple(Column(*c) for c in d["columns"])
            schema = Schema(columns, d["pk"])
            if d["version"] == VERSION or d["pk"]:
                schema.validated()
            return cls(schema, d["rows"], d["version"], d["bloom"], d["parts"], d["bounds"], d.get("next", d["rows"]))
        except (KeyError, TypeError, ValueError) as e:
            raise CorruptSegment(f"bad sidecar: {e}") from e


def read_header(spark: SparkSession, path: str) -> Header:
    """Schema and counts without a look at rows or filter."""
    if not files.exists(spark, f"{path}/_segment.json"):
        raise CorruptSegment(f"{path} is no segment")
    h = Header.from_json(files.read(spark, f"{path}/_segment.json"))
    if h.version not in (1, VERSION):
        raise CorruptSegment(f"unsupported version {h.version}")
    return h


@dataclass
class Segment:
    """A stored segment, read-only and lazy."""

    spark: SparkSession
    path: str
    header: Header

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Segment:
        """A folder as this engine writes it, or a file of the binary format (of any version)."""
        if files.is_file(spark, path):
            image = columnfile.unpack(files.read(spark, path))
            header = Header(image.schema, image.n_rows, image.version, image.bloom is not None, 1, next_seq=image.n_rows)
            return FileSegment(spark, path, header, image)
        return cls(spark, path, read_header(spark, path))

    @property
    def schema(self) -> Schema:
        return self.header.schema

    @property
    def n_rows(self) -> int:
        return self.header.n_rows

    @property
    def next_seq(self) -> int:
        return self.header.next_seq

    @property
    def df(self) -> DataFrame:
        """All rows, with their hidden order."""
        wanted = self.schema.spark(seq=True)
        if not self.header.parts:
            return self.spark.createDataFrame([], wanted)
        parts = [f"{self.path}/data/part-{i}" for i in range(self.header.parts)]
        return self.spark.read.schema(wanted).parquet(*parts)

    def column(self, name: str) -> DataFrame:
        """One column: only its chunks are read."""
        if self.schema.index(name) < 0:
            from tessera.errors import UnknownColumn

            raise UnknownColumn(name, "projection")
        return self.df.select(F.col(f"`{name}`"))

    @property
    def bloom(self) -> BloomFilter | None:
        return BloomFilter.from_bytes(files.read(self.spark, f"{self.path}/_bloom")) if self.header.has_bloom else None

    def source(self) -> Source:
        types = {c.name: c.type for c in self.schema.columns}
        return Source(self.df, types, SEQ, self.n_rows, self.header.bounds)

    def query(self, sql: str | Statement) -> Result:
        """Run a statement; COUNT(*) over everything comes from the sidecar."""
        from tessera.plans.statement import parse

        s = parse(sql) if isinstance(sql, str) else sql
        if s.aggregate == "COUNT" and not s.grouped and s.any_of is None:
            return Result(self.spark.createDataFrame([(self.n_rows,)], "`COUNT(*)` long"), ["COUNT(*)"], True)
        return execute(self.source(), s)

    def column_info(self) -> list[dict]:
        """Name, type, encoding and run-coded and raw size of each column, in schema order."""
        out = []
        for c in self.schema.columns:
            r = rle.sizes(self.df, c.name).first()
            out.append({"name": c.name, "type": c.type, "encoding": "rle", "bytes": r.rle_bytes, "raw_bytes": r.raw_bytes, "runs": r.runs})
        return out


@dataclass
class FileSegment(Segment):
    """A segment in the binary single-file format: the driver reads its directory, an executor decodes its columns."""

    image: columnfile.Image

    @property
    def df(self) -> DataFrame:
        return columnfile.frame(self.spark, self.path, self.schema)

    def column(self, name: str) -> DataFrame:
        super().column(name)  # the name's check
        return columnfile.frame(self.spark, self.path, self.schema, [name]).drop(SEQ)

    @property
    def bloom(self) -> BloomFilter | None:
        return self.image.bloom

    def column_info(self) -> list[dict]:
        names = {columnfile.RAW: "raw", columnfile.RLE: "rle"}
        return [{"name": b.column.name, "type": b.column.type, "encoding": names[b.encoding], "bytes": b.size} for b in self.image.blocks]


def export(segment: Segment, path: str) -> None:
    """Write a segment as one binary file.  The format is a single image, so its columns pass through the driver."""
    rows = segment.df.orderBy(SEQ).toArrow()
    columns = [rows[c.name].to_pylist() for c in segment.schema.columns]
    files.write(segment.spark, path, columnfile.pack(segment.schema, columns, segment.n_rows, segment.bloom))


def write(spark: SparkSession, path: str, rows: DataFrame, schema: Schema, bloom: BloomFilter | None, append: bool = False) -> Header:
    """Store rows (with their order) as a segment; ``append`` adds a part and keeps what is there."""
    old = read_header(spark, path) if append and files.exists(spark, f"{path}/_segment.json") else None
    if old and old.schema != schema:
        raise IncompatibleSegment("the stored schema is another one")
    part = old.parts if old else 0
    if not old:
        files.delete(spark, path)
    stored = rows.select(*[F.col(f"`{n}`") for n in schema.names], F.col(SEQ))
    stored.write.mode("overwrite").parquet(f"{path}/data/part-{part}")
    back = spark.read.schema(schema.spark(seq=True)).parquet(f"{path}/data/part-{part}")
    ints = [c.name for c in schema.columns if c.type == INT64]
    # widened, as the smallest int64 has no absolute value in its type
    most = [F.max(F.abs(F.col(f"`{c}`").cast("decimal(20,0)"))).alias(f"b{i}") for i, c in enumerate(ints)]
    row = back.agg(F.count("*").alias("n"), F.max(SEQ).alias("top"), *most).first()
    bounds = {c: max(int(row[f"b{i}"] or 0), old.bounds.get(c, 0) if old else 0) for i, c in enumerate(ints)}
    header = Header(schema, row["n"] + (old.n_rows if old else 0), VERSION, bloom is not None, part + 1, bounds, max(old.next_seq if old else 0, (-1 if row["top"] is None else row["top"]) + 1))
    if bloom is not None:
        files.write(spark, f"{path}/_bloom", bloom.to_bytes())
    files.write(spark, f"{path}/_segment.json", header.to_json())  # last: it names what is there
    return header
