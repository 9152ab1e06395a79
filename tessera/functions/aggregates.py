"""Aggregate functions of the dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By name; count also takes *, as the number 1.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
