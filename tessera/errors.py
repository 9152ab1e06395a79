"""Errors of the dialect, each with the place in the query text that it is about."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    start: int
    end: int


class DialectError(Exception):
    """An error that may point at a stretch of the query text."""

    def __init__(self, message: str, span: Span | None = None):
        super().__init__(message)
        self.message = message
        self.span = span

    def report(self, text: str = "") -> str:
        """The message with the line it is about and carets under the place."""
        name = type(self).__name__
        if self.span is None or not text:
            return f"{name}: {self.message}"
        start = min(self.span.start, len(text))
        begin = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", start)
        line = text[begin : stop if stop >= 0 else len(text)]
        width = max(1, min(self.span.end, begin + len(line)) - start)
        row = text.count("\n", 0, start) + 1
        gutter = f"{row} | "
        return f"{name}: {self.message}\n{gutter}{line}\n{' ' * (len(gutter) + start - begin)}{'^' * width}"


class FileNotFound(DialectError):
    """The path to open does not exist."""


class DuplicateColumn(DialectError):
    """A name stands for several columns."""


class ColumnNotFound(DialectError):
    """No column has the name, or none with the qualifier."""


class UnhandledSerial(DialectError):
    """A stored value has an encoding that cannot be read."""


class PageRead(DialectError):
    """A stored table cannot be read."""


class WrongPageType(DialectError):
    """A stored object is of another kind than needed."""


class PageFull(DialectError):
    """A row does not fit where it should be stored."""


class WrongValueType(DialectError):
    """A value has another type than its column."""


class TableNotFound(DialectError):
    """The catalog has no such table or index."""


class WrongCommand(DialectError):
    """The statement or shell command cannot be carried out."""


class ParserError(DialectError):
    """The text is not in the dialect."""
