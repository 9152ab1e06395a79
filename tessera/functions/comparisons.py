"""Two-valued comparisons with one order over all values: NULL, then numbers, then text, then binary.

Equality takes NULL as equal to NULL only. Every comparison is true or false, never unknown: where an
expression built here is unknown, the row is one that the comparison rejects, which is the same in a filter or
a join condition made of AND and OR. The forms keep what file sources can push down.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the classes of values; classes outside it (times, booleans) compare within themselves only.
CLASSES = ("number", "text", "blob")
MIRROR = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def class_of(kind: T.DataType) -> str:
    """number, text, blob, or the type's own name."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "blob"
    return kind.simpleString()


class Operand:
    """One side of a comparison. known: it cannot be NULL."""

    def __init__(self, column: Column, kind: T.DataType, known: bool = False, literal: bool = False, value: object = None):
        self.column, self.kind, self.known, self.literal, self.value = column, kind, known or literal, literal, value

    @property
    def rank(self) -> str:
        return class_of(self.kind)

    def missing(self) -> Column:
        return F.lit(False) if self.known else self.column.isNull()

    def present(self) -> Column:
        return F.lit(True) if self.known else self.column.isNotNull()


def _any(*conditions: Column) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def _same_class(operator: str, a: Operand, b: Operand) -> Column:
    x, y = a.column, b.column
    if operator == "=":
        return x == y if a.known or b.known else x.eqNullSafe(y)
    if operator == "<>":
        return x != y if a.known and b.known else ~x.eqNullSafe(y)
    if operator in (">", ">="):
        return _same_class(MIRROR[operator], b, a)
    if operator == "<":
        return x < y if a.known else _any(x < y, a.missing() if b.known else a.missing() & b.present())
    return x <= y if a.known else _any(x <= y, a.missing())


def _other_class(operator: str, low: Operand, high: Operand) -> Column:
    """low is of the class that comes first: unless NULL decides, it is the smaller."""
    both_missing = low.missing() & high.missing()
    if operator == "=":
        return both_missing
    if operator == "<>":
        return ~both_missing
    if operator == "<":
        return high.present()
    if operator == "<=":
        return high.present() | low.missing()
    if operator == ">":
        return low.present() & high.missing()
    return high.missing()


def _read(literal: Operand, kind: T.DataType) -> Operand:
    """A text literal as a value of a type outside the classes; ValueError if it is none."""
    text = str(literal.value).strip()
    if isinstance(kind, T.DateType):
        return Operand(F.lit(date.fromisoformat(text)), kind, literal=True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = datetime.fromisoformat(text).isoformat(" ")
    elif isinstance(kind, T.BooleanType) and text.lower() not in ("true", "false"):
        raise ValueError(f"{text!r} is neither true nor false")
    return Operand(F.lit(text).cast(kind), kind, literal=True)


def compare(operator: str, left: Operand, right: Operand) -> Column:
    """The comparison as a condition for filters and joins. TypeError: the types have no order; ValueError: a literal is no value of the other side's type."""
    a, b = left.rank, right.rank
    if a == b:
        return _same_class(operator, left, right)
    if a in CLASSES and b in CLASSES:
        if CLASSES.index(a) < CLASSES.index(b):
            return _other_class(operator, left, right)
        return _other_class(MIRROR[operator], right, left)
    if right.literal and b == "text":
        return _same_class(operator, left, _read(right, left.kind))
    if left.literal and a == "text":
        return _same_class(operator, _read(left, right.kind), right)
    raise TypeError(f"{left.kind.simpleString()} and {right.kind.simpleString()} have no order")
