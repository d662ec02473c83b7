"""CSV ingest: all-string read, strict casts, bad rows set aside with a reason.

Spark's reader splits records; what it can't fit into the header's width
(ragged rows) is parsed again from the record's text, in Python, which only
such rows reach; there a bare quote is an error too (in rows of the right width
Spark takes it as text).  With ``multiline`` a quoted field may hold line breaks, at the price of
one task for each file; without, files are split as usual.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SchemaError
from tessera.schema import FLOAT64, INT64, SEQ, Schema
from tessera.sources import files

_INT = r"^[+-]?[0-9]+\z"
_INF = r"^[+-]?(?i:inf(inity)?)\z"
_FLOAT = (
    r"^([+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?)"
    r"|0[xX]([0-9a-fA-F]+(\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)|(?i:nan))\z"
)
_TEXT = "_text"
#: The header is looked for in so many bytes first, and in twice as many until its record is whole.
HEAD = 1 << 16


class MissingColumn(SchemaError):
    def __init__(self, name: str) -> None:
        super().__init__(f'schema column "{name}" is missing from CSV header')


def strict(text: Column, kind: str) -> Column:
    """The field's value, or null where it isn't spelt as that type (no blanks around, no empty numbers, in range)."""
    if kind == INT64:
        return F.when(text.rlike(_INT), text.try_cast("long"))
    if kind == FLOAT64:
        value = F.when(text.rlike(_FLOAT), text.try_cast("double"))
        endless = (F.abs(value) == F.lit(float("inf"))) & ~text.rlike(_INF)
        return F.when(~F.coalesce(endless, F.lit(False)), value)
    return text


def header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first record, without blanks around them, however long it is."""
    size = HEAD
    while True:
        raw = files.head(spark, path, size)
        # records end at line breaks outside of quotes; blank lines before the first one don't count
        text = raw.decode("utf-8", "replace")
        rows = csv.reader(io.StringIO(text, newline=""), strict=True)
        try:
            first = next((r for r in rows if r), None)
            whole = len(raw) < size or next(rows, None) is not None
        except csv.Error:
            if len(raw) < size:
                raise
            whole = False
        if whole:
            break
        size *= 2
    if not first:
        raise SchemaError("read csv header: EOF")
    return [h.strip() for h in first]


def _fields(text: str) -> list[str] | str:
    """A record's fields, or what is wrong with it."""
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error as e:
        return f"csv read error: {e}"
    return rows[0] if rows else []


def _bare_quote(text: str) -> bool:
    """Whether a quote stands inside of an unquoted field, or after a closing one."""
    quoted, start = False, True
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                elif text[i + 1 : i + 2] in ("", ",", "\n", "\r"):
                    quoted = False
                else:
                    return True
        elif c == '"':
            if not start:
                return True
            quoted = True
        start = not quoted and c == ","
        i += 1
    return quoted


def _again():
    """Records given as text: an array of their fields (null: broken), and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, why = [], []
            for text in b.column(1).to_pylist():
                got = 'csv read error: bare " in field' if _bare_quote(text) else _fields(text)
                out.append(None if isinstance(got, str) else got)
                why.append(got if isinstance(got, str) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string())), pa.array(why, pa.string())], [SEQ, "f", "why"])

    return run


@dataclass
class Loaded:
    """``good``: the schema's columns and SEQ.  ``bad``: SEQ and the reason.  Both are lazy parts of one read."""

    good: DataFrame
    bad: DataFrame
    rows: DataFrame


def read(spark: SparkSession, path: str, schema: Schema, multiline: bool = True) -> Loaded:
    names = header(spark, path)
    place = {n: i for i, n in enumerate(names)}  # of repeated names the last one counts
    for n in schema.names:
        if n not in place:
            raise MissingColumn(n)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    reader = spark.read.schema(T.StructType([*fields, T.StructField(_TEXT, T.StringType())]))
    reader = reader.options(header=True, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=_TEXT, enforceSchema=True, columnPruning=False)
    raw = reader.csv(path).withColumn(SEQ, F.monotonically_increasing_id())
    whole = F.array(*[F.coalesce(F.col(f.name), F.lit("")) for f in fields])
    plain = raw.where(F.col(_TEXT).isNull()).select(SEQ, whole.alias("f"), F.lit(None).cast("string").alias("why"))
    again = raw.where(F.col(_TEXT).isNotNull()).select(SEQ, _TEXT, whole.alias("f")).mapInArrow(_again(), f"{SEQ} long, f array<string>, why string")
    rows = plain.unionByName(again)
    took = rows.select(SEQ, F.size("f").alias("n"), "why", *[F.get(F.col("f"), F.lit(place[c.name])).alias(f"t{i}") for i, c in enumerate(schema.columns)])
    reason = F.col("why")
    cast = {}
    for i, c in enumerate(schema.columns):
        cast[c.name] = strict(F.col(f"t{i}"), c.type)
        short = F.format_string(f'column "{c.name}": missing field (CSV has %d fields, want index {place[c.name]})', F.col("n"))
        wrong = F.format_string(f'column "{c.name}": cannot parse "%s" as {c.type}', F.col(f"t{i}"))
        reason = F.coalesce(reason, F.when(F.col(f"t{i}").isNull(), short), F.when(cast[c.name].isNull(), wrong))
    took = took.withColumn("reason", reason)
    good = took.where("reason is null").select(*[F.coalesce(cast[c.name], F.lit("" if c.type == "string" else 0).cast(schema.spark()[c.name].dataType)).alias(c.name) for c in schema.columns], SEQ)
    return Loaded(good, took.where("reason is not null").select(SEQ, "reason"), took)
