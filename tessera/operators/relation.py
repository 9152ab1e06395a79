"""Relations: a DataFrame whose columns have unique internal names, and what they are called in a query."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, DuplicateColumn, Span
from tessera.functions.comparisons import Operand


@dataclass(frozen=True)
class Output:
    """A column: its internal name, its name, the qualifiers it goes by, and the one it is shown with."""

    internal: str
    name: str
    qualifiers: tuple[str, ...]
    kind: T.DataType
    nullable: bool = True

    @property
    def dotted(self) -> str:
        return f"{self.qualifiers[-1]}.{self.name}" if self.qualifiers else self.name


@dataclass(frozen=True)
class Relation:
    frame: DataFrame
    outputs: tuple[Output, ...]
    #: The same rows, or those that some of the table's files give, with the columns of their place and the order by it;
    #: only for chains over one stored table.
    ordered: Callable[[Sequence[str] | None], tuple[DataFrame, list[Column]]] | None = None

    def resolve(self, name: str, qualifier: str | None, span: Span | None) -> Output:
        """The one column that the name stands for; exact spelling goes before other case."""
        for same in (lambda a, b: a == b, lambda a, b: a.lower() == b.lower()):
            found = [o for o in self.outputs if same(o.name, name) and (qualifier is None or any(same(q, qualifier) for q in o.qualifiers))]
            if len(found) > 1:
                raise DuplicateColumn(f"{name} stands for {', '.join(o.dotted for o in found)}", span)
            if found:
                return found[0]
        shown = f"{qualifier}.{name}" if qualifier else name
        raise ColumnNotFound(f"no column is called {shown}; there are {', '.join(o.dotted for o in self.outputs)}", span)

    def operand(self, name: str, qualifier: str | None, span: Span | None) -> Operand:
        found = self.resolve(name, qualifier, span)
        return Operand(F.col(found.internal), found.kind, known=not found.nullable)

    def shown(self) -> list[str]:
        """The names of the result: bare where that is unique, else with the qualifier."""
        count = Counter(o.name.lower() for o in self.outputs)
        return [o.name if count[o.name.lower()] == 1 else o.dotted for o in self.outputs]

    def result(self) -> DataFrame:
        names = self.shown()
        twice = [n for n, c in Counter(names).items() if c > 1]
        if twice:
            raise DuplicateColumn(f"the result has two columns {twice[0]}")
        return self.frame.select(*[F.col(o.internal).alias(n) for o, n in zip(self.outputs, names)])


def named(frame: DataFrame, qualifiers: Sequence[str], prefix: str, ordered: Callable[[Sequence[str] | None], tuple[DataFrame, list[Column]]] | None = None) -> Relation:
    """A stored table or subquery as a relation: internal names are the prefix and a number."""
    outputs = tuple(Output(f"{prefix}_{i}", f.name, tuple(qualifiers), f.dataType, f.nullable) for i, f in enumerate(frame.schema))

    def renamed(source: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return source.select(*[F.col(f"`{o.name}`").alias(o.internal) for o in outputs], *extra)

    def again(files: Sequence[str] | None = None) -> tuple[DataFrame, list[Column]]:
        source, order = ordered(files)
        return renamed(source, [c for c in source.columns if c not in frame.columns]), order

    return Relation(renamed(frame), outputs, again if ordered else None)


def mapped(relation: Relation, change: Callable[[DataFrame], DataFrame], extra: Callable[[DataFrame], DataFrame] | None = None, **fields) -> Relation:
    """The relation with its frame changed; extra is the change that keeps further columns, for the ordered frame."""
    more = extra or change

    def again(files: Sequence[str] | None = None) -> tuple[DataFrame, list[Column]]:
        frame, order = relation.ordered(files)
        return more(frame), order

    return replace(relation, frame=change(relation.frame), ordered=again if relation.ordered else None, **fields)
