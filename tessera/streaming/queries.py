"""Statements of the dialect over streams.

A streaming DataFrame is registered like any table; select, filter, project and joins with stored tables then
give a streaming result, and grouping gives running aggregates. LIMIT has no meaning for an endless input and
is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine
from tessera.errors import WrongCommand
from tessera.plans import nodes as n
from tessera.plans.parser import parse


def stream(engine: Engine, text: str) -> DataFrame:
    """The streaming result of a select over at least one registered stream."""
    statement = parse(text)
    if not isinstance(statement, n.Select):
        raise WrongCommand("only a select runs over streams", statement.span)
    if statement.limit is not None:
        raise WrongCommand("limit does not go with streams", statement.span)
    result = engine.plan(statement)[0]
    if not result.isStreaming:
        raise WrongCommand("none of the tables is a stream", statement.source.span)
    return result


def start(engine: Engine, text: str, sink: str, checkpoint: str, mode: str = "append", **options: str) -> StreamingQuery:
    """Runs the select continuously into a sink; a restart with the same checkpoint goes on where it stopped."""
    return stream(engine, text).writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).start()
