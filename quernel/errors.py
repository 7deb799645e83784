"""Errors of the engine. All are raised before a query runs."""

from __future__ import annotations


class QuernelError(Exception):
    """Base of all errors."""


class SqlParseError(QuernelError):
    """Text that is not of the dialect; ``position`` is the offset of the character at fault."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} (at position {position})")
        self.position = position


class BindError(QuernelError):
    """A statement that has no meaning over the catalog's tables."""


class UnknownTable(BindError):
    pass


class UnknownColumn(BindError):
    pass


class AmbiguousColumn(BindError):
    pass


class TypeMismatch(BindError):
    pass


class CsvError(QuernelError):
    """A CSV file that cannot be loaded."""
