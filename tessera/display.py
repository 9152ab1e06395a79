"""Results as text: boxed tables and lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame

#: Corners and edges of the first, middle and last rule, then the bar and the line.
FRAMES = {"box": ("┌┬┐", "├┼┤", "└┴┘", "│", "─"), "ascii": ("+++", "+++", "+++", "|", "-")}
#: Rows that decide the widths of the columns.
LEADING = 15


def cell(value: object) -> str:
    if value is None:
        return ""
    return "[" + ", ".join(f"{b:02x}" for b in value) + "]" if isinstance(value, (bytes, bytearray)) else str(value)


def bare(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def box(names: list[str], rows: Iterable[Iterable[object]], style: str = "box") -> Iterator[str]:
    """Lines of a table with frames, drawn or in ASCII: heads centred, cells to the left. Without rows there are no lines."""
    texts = ([cell(v) for v in row] for row in rows)
    first = list(islice(texts, LEADING))
    if not first:
        return
    top, middle, bottom, bar, line = FRAMES[style]
    heads = [bare(n) for n in names]
    widths = [max([len(h.encode()), *(len(r[i].encode()) for r in first)]) for i, h in enumerate(heads)]

    def rule(ends: str) -> str:
        return ends[0] + ends[1].join(line * (w + 2) for w in widths) + ends[2]

    yield rule(top)
    yield bar + bar.join(f" {h.center(w)} " for h, w in zip(heads, widths)) + bar
    yield rule(middle)
    for row in chain(first, texts):
        yield bar + bar.join(f" {v.ljust(w)} " for v, w in zip(row, widths)) + bar
    yield rule(bottom)


def listing(names: list[str], rows: Iterable[Iterable[object]]) -> Iterator[str]:
    """A head and the rows, cells parted by bars. Without rows there are no lines."""
    head = "|".join(map(bare, names))
    for row in rows:
        if head is not None:
            yield head
            head = None
        yield "|".join(map(cell, row))


def show(frame: DataFrame, style: str = "box", out=print) -> None:
    """Prints a result as its rows arrive; the driver holds one partition at a time."""
    if not frame.columns:
        return
    rows = frame.toLocalIterator()
    for line in listing(frame.columns, rows) if style == "list" else box(frame.columns, rows, style):
        out(line)
