"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.errors import Span

NOWHERE = Span(0, 0)


@dataclass(frozen=True)
class Node:
    span: Span = field(default=NOWHERE, compare=False, repr=False, kw_only=True)


@dataclass(frozen=True)
class Column(Node):
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Call(Node):
    function: str
    arguments: tuple[Column | Star, ...]

    def __str__(self) -> str:
        return f"{self.function}({', '.join('*' if isinstance(a, Star) else str(a) for a in self.arguments)})"


@dataclass(frozen=True)
class Item(Node):
    value: Column | Star | Call
    alias: str | None = None


@dataclass(frozen=True)
class Compare(Node):
    operator: str
    left: Column | Literal
    right: Column | Literal


@dataclass(frozen=True)
class And(Node):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Node):
    left: Predicate
    right: Predicate


Predicate = Compare | And | Or


@dataclass(frozen=True)
class Table(Node):
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Subquery(Node):
    select: Select
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    left: Source
    right: Source
    on: Predicate | None = None


Source = Table | Subquery | Join


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    source: Source
    where: Predicate | None = None
    groups: tuple[Column, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ColumnDefinition(Node):
    name: str
    type: str
    primary: bool = False


@dataclass(frozen=True)
class CreateTable(Node):
    name: str
    columns: tuple[ColumnDefinition, ...]
    without_rowid: bool = False


@dataclass(frozen=True)
class CreateIndex(Node):
    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Inspect(Node):
    """explain, info or test in front of a select."""

    kind: str
    select: Select


Statement = Select | CreateTable | CreateIndex | Inspect
