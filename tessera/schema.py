"""Schemas: ordered columns of three types, one of them the key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.errors import DuplicateColumn, KeyNotFound, NoColumns, RowError, SchemaError

INT64, FLOAT64, STRING = "int64", "float64", "string"
SPARK = {INT64: T.LongType(), FLOAT64: T.DoubleType(), STRING: T.StringType()}
_PYTHON = {INT64: int, FLOAT64: float, STRING: str}
_NAMES = {T.LongType(): INT64, T.DoubleType(): FLOAT64, T.StringType(): STRING}
#: Hidden column of stored rows: their order.
SEQ = "_seq"


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    def fits(self, value: object) -> bool:
        """Exact types only: no bool for int, no int for float; int64 in range."""
        if type(value) is not _PYTHON[self.type]:
            return False
        return self.type != INT64 or -(1 << 63) <= value < 1 << 63


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    pk: str

    @classmethod
    def of(cls, spec: Sequence[tuple[str, str]] | str, pk: str) -> Schema:
        pairs = parse_spec(spec) if isinstance(spec, str) else spec
        return cls(tuple(Column(*p) for p in pairs), pk).validated()

    def validated(self) -> Schema:
        if not self.columns:
            raise NoColumns("schema has no columns")
        seen: set[str] = set()
        for c in self.columns:
            if c.name in seen:
                raise DuplicateColumn(f'duplicate column "{c.name}"')
            if c.type not in SPARK:
                raise SchemaError(f'unknown type "{c.type}"')
            seen.add(c.name)
        if self.pk not in seen:
            raise KeyNotFound(f'key "{self.pk}" is not a column')
        if len(self.columns) > 65_535:
            raise SchemaError("too many columns")
        return self

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def index(self, name: str) -> int:
        """Place of a column, or -1; names are case-sensitive."""
        return next((i for i, c in enumerate(self.columns) if c.name == name), -1)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def pk_index(self) -> int:
        return self.index(self.pk)

    @property
    def key(self) -> Column:
        return self.columns[self.pk_index]

    def spark(self, seq: bool = False) -> T.StructType:
        own = [T.StructField(c.name, SPARK[c.type], False) for c in self.columns]
        return T.StructType(own + ([T.StructField(SEQ, T.LongType(), False)] if seq else []))

    def check_row(self, row: Sequence) -> None:
        """Raise RowError unless the row has the right number of values of the right types and no null."""
        if len(row) != len(self.columns):
            raise RowError(f"row has {len(row)} values, schema has {len(self.columns)} columns")
        # the key's type is told before that of the others
        order = sorted(range(len(row)), key=lambda i: i != self.pk_index)
        for i in order:
            c = self.columns[i]
            if row[i] is None:
                raise RowError(f'column "{c.name}": null')
            if not c.fits(row[i]):
                raise RowError(f'column "{c.name}": {type(row[i]).__name__} is not {c.type}')


def parse_spec(spec: str) -> list[tuple[str, str]]:
    """``name:type,...`` with types int64, float64, string; blanks around names and types don't count."""
    out: list[tuple[str, str]] = []
    for part in spec.split(","):
        name, colon, kind = (x.strip() for x in part.strip().partition(":"))
        if not colon or not name:
            raise SchemaError(f'bad column spec "{part.strip()}": want name:type')
        if kind not in SPARK:
            raise SchemaError(f'unknown type "{kind}" for column "{name}" (want int64, float64 or string)')
        if any(n == name for n, _ in out):
            raise DuplicateColumn(f'duplicate column "{name}"')
        out.append((name, kind))
    return out


def of_frame(fields: T.StructType) -> list[tuple[str, str]]:
    """Columns of a frame whose types the engine has; ints are to be widened before."""
    return [(f.name, _NAMES[f.dataType]) for f in fields if f.dataType in _NAMES and f.name != SEQ]
