"""Errors of the engine.  Each kind of failure can be caught by itself."""


class TesseraError(Exception):
    """Base of all errors that the engine raises on purpose."""


class ParseError(TesseraError):
    """A statement outside the dialect; ``position`` is a byte offset, or None for rules about the whole statement."""

    def __init__(self, message: str, position: int | None = None) -> None:
        self.position = position
        super().__init__(f"parse error at position {position}: {message}" if position is not None else f"parse error: {message}")


class UnknownColumn(TesseraError):
    def __init__(self, name: str, where: str) -> None:
        self.name = name
        super().__init__(f'unknown column: "{name}" (in {where})' if where != "projection" else f'unknown column: "{name}" (projection)')


class TypeMismatch(TesseraError):
    pass


class SumOverflow(TesseraError):
    """An int64 sum left its range after some row, in row order."""

    def __init__(self, column: str, group: object = None, grouped: bool = False) -> None:
        self.group = group
        super().__init__(f'sum overflow: column "{column}"' + (f" in group {group}" if grouped else ""))


class SchemaError(TesseraError):
    pass


class NoColumns(SchemaError):
    pass


class DuplicateColumn(SchemaError):
    pass


class KeyNotFound(SchemaError):
    pass


class RowError(TesseraError):
    """A row that doesn't fit the schema."""


class InvalidParameters(TesseraError):
    pass


class CorruptFilter(TesseraError):
    pass


class CorruptRuns(TesseraError):
    pass


class CorruptSegment(TesseraError):
    pass


class IncompatibleSegment(TesseraError):
    """A segment that can be read but not resumed: it lacks a key or a filter."""
