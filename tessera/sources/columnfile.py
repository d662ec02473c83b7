"""The binary single-file segment format, versions 1 and 2, as a Spark data source.

``spark.dataSource.register(ColumnFileSource)`` and then
``spark.read.format("columnfile").load(path)``, for paths that the executors
have mounted; ``frame`` reads from any store, and only the columns asked for.
A file is one task, as the format has no places to split at; a folder gives a
task for each of its files.  Encoding and decoding of whole images is ``pack``
and ``unpack``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.errors import CorruptFilter, CorruptRuns, CorruptSegment
from tessera.functions import rle
from tessera.functions.bloom import BloomFilter, read_varint, varint
from tessera.schema import FLOAT64, INT64, SEQ, STRING, Column, Schema

# fixed values of the format
MAGIC, BLOOM_MAGIC = b"UCOL", b"UBLM"
WIRE = {INT64: 0, FLOAT64: 1, STRING: 2}
RAW, RLE = 0, 1
HAS_KEY, HAS_BLOOM = 1, 2
_TYPES = {v: k for k, v in WIRE.items()}
_ARROW = {INT64: pa.int64(), FLOAT64: pa.float64(), STRING: pa.string()}


@dataclass(frozen=True)
class Block:
    column: Column
    encoding: int
    start: int
    size: int


@dataclass
class Image:
    """A parsed file: its directory, and the bytes that columns are decoded from on demand."""

    raw: bytes
    version: int
    n_rows: int
    pk: str
    blocks: list[Block]
    bloom: BloomFilter | None

    @property
    def schema(self) -> Schema:
        return Schema(tuple(b.column for b in self.blocks), self.pk)

    def column(self, name: str):
        b = next((b for b in self.blocks if b.column.name == name), None)
        if b is None:
            raise KeyError(name)
        part = self.raw[b.start : b.start + b.size]
        try:
            return (rle.decode if b.encoding == RLE else rle.decode_raw)(part, b.column.type, self.n_rows)
        except CorruptRuns as e:
            raise CorruptSegment(f'column "{name}": {e}') from e

    def arrow(self, names: Sequence[str] | None = None) -> pa.RecordBatch:
        """All columns, or those named; only they are decoded."""
        kinds = {b.column.name: b.column.type for b in self.blocks}
        names = list(kinds) if names is None else list(names)
        return pa.RecordBatch.from_arrays([pa.array(self.column(n), _ARROW[kinds[n]]) for n in names], names)


def pack(schema: Schema, columns: Sequence, n_rows: int, bloom: BloomFilter | None = None) -> bytes:
    """A version-2 file of columns in schema order; every column is run-coded."""
    flags = (HAS_KEY if schema.pk else 0) | (HAS_BLOOM if bloom else 0)
    out = [struct.pack("<4sHHQ", MAGIC, 2, len(schema.columns), n_rows), varint(1), bytes([flags])]
    name = lambda s: varint(len(s.encode())) + s.encode()
    if schema.pk:
        out.append(name(schema.pk))
    for c, values in zip(schema.columns, columns):
        body = rle.encode(values, c.type)
        out += [name(c.name), bytes([WIRE[c.type], RLE]), varint(len(body)), body]
    if bloom:
        out += [BLOOM_MAGIC, struct.pack("<H", 1), bloom.to_bytes()]
    return b"".join(out)


def unpack(raw: bytes) -> Image:
    """Read the directory; payloads stay as they are.  Raises CorruptSegment on anything that isn't whole."""
    at = 16

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise CorruptSegment(f"truncated at byte {at}")
        at += n
        return raw[at - n : at]

    def number() -> int:
        nonlocal at
        value, at = read_varint(raw, at, CorruptSegment)
        return value

    if len(raw) < 16 or raw[:4] != MAGIC:
        raise CorruptSegment("bad magic")
    version, n_columns, n_rows = struct.unpack_from("<HHQ", raw, 4)
    if version not in (1, 2):
        raise CorruptSegment(f"unsupported version {version}")
    pk, flags = "", 0
    if version == 2:
        size = number()
        if not size:
            raise CorruptSegment("empty flags")
        flags = take(size)[0]  # further flag bytes are for later versions
        if flags & HAS_KEY:
            pk = take(number()).decode()
    blocks: list[Block] = []
    for _ in range(n_columns):
        label = take(number()).decode()
        wire, encoding = take(2)
        if wire not in _TYPES or encoding not in (RAW, RLE):
            raise CorruptSegment(f'column "{label}": type {wire}, encoding {encoding}')
        size = number()
        blocks.append(Block(Column(label, _TYPES[wire]), encoding, at, size))
        take(size)
    if len({b.column.name for b in blocks}) < len(blocks):
        raise CorruptSegment("repeated column name")
    bloom = None
    if flags & HAS_BLOOM:
        if take(4) != BLOOM_MAGIC or struct.unpack("<H", take(2))[0] != 1:
            raise CorruptSegment("bad filter trailer")
        try:
            bloom = BloomFilter.from_bytes(raw[at:])
        except CorruptFilter as e:
            raise CorruptSegment(f"filter: {e}") from e
    return Image(raw, version, n_rows, pk, blocks, bloom)


def frame(spark: SparkSession, path: str, schema: Schema, names: Sequence[str] | None = None) -> DataFrame:
    """The file's columns (those named, if given) and the order of its rows, decoded by an executor; any path that Spark reads will do."""
    names = list(schema.names if names is None else names)
    out = schema.spark(seq=True)
    out = type(out)([f for f in out.fields if f.name in names or f.name == SEQ])
    order = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                image = unpack(raw)
                got = image.arrow([n for n in order if n != SEQ])
                columns = [pa.array(range(image.n_rows), pa.int64()) if n == SEQ else got.column(n) for n in order]
                yield pa.RecordBatch.from_arrays(columns, order)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, out)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [_File(str(f)) for f in (sorted(x for x in p.iterdir() if x.is_file()) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield unpack(Path(partition.path).read_bytes()).arrow()


class ColumnFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "columnfile"

    def schema(self):
        first = _Reader(self.options["path"]).partitions()[0]
        return unpack(Path(first.path).read_bytes()).schema.spark()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
