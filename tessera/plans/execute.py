"""From a statement to a DataFrame: names and types are checked strictly, then Catalyst plans the rest."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import TypeMismatch, UnknownColumn
from tessera.operators.sums import LARGEST, check_prefixes, total
from tessera.plans.statement import Condition, Statement, parse, quoted
from tessera.schema import FLOAT64, INT64, SEQ, STRING, of_frame

_KIND = {int: INT64, float: FLOAT64, str: STRING}
_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


@dataclass
class Source:
    """Rows to query: columns by type, a column that orders them, and bounds of int columns where known.

    ``bounds``: of an int64 column, the largest absolute value; with ``n_rows``
    it can prove that no sum overflows, without looking at the data.
    """

    df: DataFrame
    types: dict[str, str]
    seq: str
    n_rows: int | None = None
    bounds: dict[str, int] | None = None

    @classmethod
    def of(cls, df: DataFrame, seq: str = SEQ) -> Source:
        """A frame as it is; columns of other types than the three can't be named."""
        return cls(df, {n: k for n, k in of_frame(df.schema) if n != SEQ}, seq)

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")


@dataclass
class Result:
    """``df`` is lazy and in no order, unless the statement is grouped; ``ordered()`` and ``rows()`` are in row order."""

    df: DataFrame
    columns: list[str]
    is_aggregate: bool
    order: str | None = None

    def ordered(self) -> DataFrame:
        """In storage order (groups: order of discovery), without the ordering column."""
        df = self.df.orderBy(self.order) if self.order else self.df
        return df.drop(self.order) if self.order else df

    def rows(self, limit: int | None = None) -> list[tuple]:
        df = self.ordered()
        return [tuple(r) for r in (df.limit(limit) if limit else df).collect()]


def _lookup(src: Source, name: str, where: str) -> str:
    if name not in src.types:
        raise UnknownColumn(name, where)
    return src.types[name]


def _checked(src: Source, c: Condition) -> None:
    kind = _lookup(src, c.column, "WHERE")
    if _KIND[type(c.value)] != kind:
        raise TypeMismatch(f"type mismatch at position {c.at}: column {quoted(c.column)} is {kind}, literal is {_KIND[type(c.value)]}")


def predicate(src: Source, c: Condition) -> Column:
    """The comparison as a column.  NaN is neither above nor equal to anything, where Spark holds it for the largest."""
    kind = src.types[c.column]
    value = F.lit(c.value).cast({INT64: "long", FLOAT64: "double", STRING: "string"}[kind])
    test = _OPS[c.op](src.column(c.column), value)
    return test & ~F.isnan(src.column(c.column)) if kind == FLOAT64 and c.op in (">", ">=") else test


def _filtered(src: Source, s: Statement) -> DataFrame:
    if s.any_of is None:
        return src.df
    for c in (c for group in s.any_of for c in group):
        _checked(src, c)
    either = [reduce(operator.and_, [predicate(src, c) for c in group]) for group in s.any_of]
    return src.df.where(reduce(operator.or_, either))


def _no_overflow(src: Source, df: DataFrame, s: Statement) -> None:
    proven = src.bounds and src.n_rows is not None and src.bounds.get(s.summed, LARGEST) * src.n_rows <= LARGEST
    if not proven:
        check_prefixes(df, s.summed, src.seq, s.group_by)


def execute(src: Source, statement: Statement | str) -> Result:
    """Check and plan a statement.  Only an int64 sum whose range isn't known beforehand runs a job (its overflow check)."""
    s = parse(statement) if isinstance(statement, str) else statement
    if s.aggregate is None and s.columns is not None:
        for name in s.columns:
            _lookup(src, name, "projection")
    elif s.aggregate == "SUM" and not s.grouped:
        _lookup(src, s.summed, "projection")
    df = _filtered(src, s)
    if s.grouped:
        _lookup(src, s.group_by, "GROUP BY")
    kind = None
    if s.aggregate == "SUM":
        kind = _lookup(src, s.summed, "SUM")
        if kind == STRING:
            raise TypeMismatch(f"type mismatch: SUM({s.summed}): column is {kind}")
        if kind == INT64:
            _no_overflow(src, df, s)
    if s.aggregate is None:
        names = list(src.types) if s.columns is None else s.columns
        hidden = F.col(src.seq).alias("_order")
        return Result(df.select(*[src.column(n) for n in names], hidden), names, False, "_order")
    name = f"SUM({s.summed})" if kind else "COUNT(*)"
    value = (total(s.summed, kind) if kind else F.count(F.lit(1))).alias(name)
    if not s.grouped:
        return Result(df.agg(value), [name], True)
    groups = df.groupBy(src.column(s.group_by)).agg(value, F.min(src.seq).alias("_order"))
    return Result(groups, [s.group_by, name], False, "_order")
