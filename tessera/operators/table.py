"""Writable tables: batches of rows are checked, made unique and stored as a segment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import IncompatibleSegment, RowError
from tessera.functions.bloom import BloomFilter
from tessera.operators import dedup
from tessera.schema import SEQ, Schema
from tessera.sources import segment
from tessera.sources.segment import Header, Segment

EXACT, BLOOM, OFF = "exact", "bloom", "off"


@dataclass(frozen=True)
class Options:
    """mode: exact (first row of a key wins), bloom (bit-exact filter, false positives included) or off."""

    mode: str = EXACT
    expected_items: int = 1_000_000
    target_rate: float = 0.01


@dataclass
class Stats:
    accepted: int = 0
    rejected: int = 0
    errors: list[str] = field(default_factory=list)


class Table:
    """Rows accepted so far (a lazy frame), the filter, and counts.

    A resumed table knows its segment's keys but holds none of its rows: flushing
    to the same path adds a part, so that nothing stored is ever lost.
    """

    def __init__(self, spark: SparkSession, schema: Schema, options: Options = Options(), resumed: Segment | None = None, bloom: BloomFilter | None = None) -> None:
        if options.mode not in (EXACT, BLOOM, OFF):
            raise ValueError(f"unknown mode {options.mode!r}")
        self.spark, self.schema, self.options, self.resumed = spark, schema.validated(), options, resumed
        self.bloom = bloom or (BloomFilter.sized(options.expected_items, options.target_rate) if options.mode == BLOOM else None)
        self.rows: DataFrame = spark.createDataFrame([], schema.spark(seq=True))
        self.stats = Stats()
        self._next = resumed.next_seq if resumed else 0

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Table:
        """Resume a segment with a key and a filter: keys it has stay rejected."""
        s = Segment.open(spark, path)
        if s.header.version != segment.VERSION or not s.schema.pk:
            raise IncompatibleSegment("the segment has no key")
        if (bloom := s.bloom) is None:
            raise IncompatibleSegment("the segment has no filter")
        return cls(spark, s.schema, Options(BLOOM), s, bloom)

    @classmethod
    def append_to(cls, spark: SparkSession, path: str) -> Table:
        """Resume a segment by its stored keys, exactly; no filter is needed."""
        s = Segment.open(spark, path)
        return cls(spark, s.schema, Options(EXACT), s)

    def insert(self, rows: Iterable[Sequence]) -> Stats:
        """Offer rows in order.  Rows that don't fit are rejected one by one; the others go in together."""
        good = []
        before = len(self.stats.errors)
        for row in rows:
            try:
                self.schema.check_row(row)
                good.append(tuple(row))
            except RowError as e:
                self.stats.errors.append(str(e))
        self.stats.rejected += len(self.stats.errors) - before
        if good:
            base = self._next
            df = self.spark.createDataFrame([(*r, base + i) for i, r in enumerate(good)], self.schema.spark(seq=True))
            self.insert_frame(df)
        return self.stats

    def insert_frame(self, df: DataFrame, seq: str = SEQ) -> Stats:
        """Offer a frame of the schema's columns, ordered by `seq` (a unique long); nulls are rejected.

        Rows come after all that were offered or stored before, so order
        numbers that begin below theirs are moved up.
        """
        cols = [F.col(f"`{c.name}`") for c in self.schema.columns]
        rows = df.select(*cols, F.col(seq).cast("long").alias(SEQ))
        whole = rows.dropna(subset=[f"`{n}`" for n in self.schema.names]) if any(f.nullable for f in rows.schema.fields[:-1]) else rows
        base = rows.agg(F.count("*").alias("n"), F.min(SEQ).alias("least"), F.max(SEQ).alias("top")).first()
        # what was offered before, or is stored, comes first
        shift = max(0, self._next - base.least) if base.n else 0
        if shift:
            whole = whole.withColumn(SEQ, F.col(SEQ) + F.lit(shift))
        accepted = whole
        if self.options.mode == EXACT:
            accepted = dedup.first_wins(dedup.unseen(whole, self.schema, self.rows) if self.stats.accepted else whole, self.schema)
            if self.resumed:
                accepted = dedup.unseen(accepted, self.schema, self.resumed.df)
        elif self.options.mode == BLOOM:
            accepted, self.bloom = dedup.bloom_pass(whole, self.schema, self.bloom)
        accepted = accepted.persist()  # later batches ask it again
        n = accepted.count()
        self.stats.accepted += n
        self.stats.rejected += base.n - n
        self.rows = self.rows.unionByName(accepted)
        if base.n:
            self._next = base.top + shift + 1
        return self.stats

    def __len__(self) -> int:
        return self.stats.accepted

    def source(self):
        from tessera.plans.execute import Source

        return Source(self.rows, {c.name: c.type for c in self.schema.columns}, SEQ)

    def flush(self, path: str) -> Header:
        """Store what was accepted; again to the same place gives the same segment.  A resumed table adds a part to its own."""
        same = self.resumed is not None and self.resumed.path == path
        return segment.write(self.spark, path, self.rows, self.schema, self.bloom, append=same)
