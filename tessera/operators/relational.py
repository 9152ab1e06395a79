"""The relational operators: filter, project, join, group and limit over relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.aggregates import AGGREGATES

from .relation import Output, Relation, mapped


def filtered(relation: Relation, condition: Column) -> Relation:
    return mapped(relation, lambda frame: frame.where(condition))


def projected(relation: Relation, outputs: Sequence[Output]) -> Relation:
    """The outputs, whose internal names are the relation's; one column may come out under several names."""
    fresh, columns, seen = [], [], set()
    for i, o in enumerate(outputs):
        internal = o.internal if o.internal not in seen else f"{o.internal}_{i}"
        seen.add(o.internal)
        columns.append(F.col(o.internal).alias(internal))
        fresh.append(Output(internal, o.name, o.qualifiers, o.kind, o.nullable))
    own = {o.internal for o in relation.outputs}
    return mapped(
        relation,
        lambda frame: frame.select(*columns),
        lambda frame: frame.select(*columns, *[c for c in frame.columns if c not in own]),
        outputs=tuple(fresh),
    )


def joined(left: Relation, right: Relation, condition: Column | None, hint: str | None = None) -> Relation:
    """All pairs, or those that meet the condition. Catalyst picks the side to build and the strategy."""
    other = right.frame.hint(hint) if hint else right.frame
    frame = left.frame.crossJoin(other) if condition is None else left.frame.join(other, condition, "inner")
    return Relation(frame, left.outputs + right.outputs)


def grouped(relation: Relation, keys: Sequence[Output], calls: Sequence[tuple[str, Output | None, str, str]]) -> Relation:
    """calls: function, argument (None for every row), internal name, name. Rows of equal keys, NULL too, are one group."""
    measures = [AGGREGATES[f](F.lit(1) if a is None else F.col(a.internal)).alias(internal) for f, a, internal, _ in calls]
    columns = [F.col(k.internal) for k in keys]
    frame = relation.frame.groupBy(*columns).agg(*measures) if measures else relation.frame.select(*columns).distinct()
    made = tuple(Output(internal, name, (), frame.schema[internal].dataType) for _, _, internal, name in calls)
    return Relation(frame, tuple(keys) + made)


def limited(relation: Relation, count: int, offset: int = 0) -> Relation:
    """The first rows. Over one stored table of several partitions, first means its stored order.

    Then the table's files are tried in the order of their paths, one, two, four and so on, until they give enough
    rows; only these are read and ordered, by a top-k without a shuffle of the rows.
    """
    if relation.ordered is None or count == 0 or (not relation.frame.isStreaming and relation.frame.rdd.getNumPartitions() <= 1):
        frame = relation.frame
    else:
        files = sorted(relation.frame.inputFiles())
        tried, wanted = 1, count + offset
        while tried < len(files) and relation.ordered(files[:tried])[0].limit(wanted).count() < wanted:
            tried *= 2
        whole, order = relation.ordered(files[:tried] if tried < len(files) else None)
        frame = whole.orderBy(*order)
    own = [F.col(o.internal) for o in relation.outputs]
    frame = frame.offset(offset).limit(count) if offset else frame.limit(count)
    return Relation(frame.select(*own), relation.outputs)
