"""The engine: a catalog, and statements of the dialect that run against it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .display import show
from .errors import DialectError
from .plans import nodes as n
from .plans.parser import parse
from .plans.planner import Plan, Planner
from .sources import pagefile
from .sources.catalog import Catalog

#: Join strategies that the test statement compares, and rows of each result that it prints.
STRATEGIES, PRINTED = ("BROADCAST", "MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL"), 10


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """A directory of Parquet tables, or a single-file database."""
        return cls(spark, pagefile.catalog(spark, path) if pagefile.is_database(path) else Catalog.of_directory(spark, path))

    def sql(self, text: str) -> DataFrame:
        """Runs one statement. Inspecting statements print what they find; the result is lazy."""
        statement = parse(text)
        if isinstance(statement, n.Select):
            return self.plan(statement)[0]
        if isinstance(statement, n.CreateTable):
            return self.catalog.create_table(statement.name, [(c.name, c.type) for c in statement.columns], text.strip().rstrip(";"))
        if isinstance(statement, n.CreateIndex):
            return self.catalog.create_index(statement.name, statement.table, statement.columns, text.strip().rstrip(";"), statement.span)
        if statement.kind == "explain":
            print(self.explain(statement.select))
            return self.empty()
        if statement.kind == "info":
            frame, _ = self.plan(statement.select)
            print(self.explain(statement.select))
            print(f"# rows: {frame.count()}")
            return frame
        return self.compare(statement.select)

    def plan(self, select: n.Select, hint: str | None = None) -> tuple[DataFrame, Plan]:
        relation, plan = Planner(self.catalog, hint).select(select)
        return relation.result(), plan

    def explain(self, select: n.Select) -> str:
        """The plan in the dialect's terms, the ways to read its tables, and Spark's own plan."""
        frame, _ = self.plan(select)
        physical = self.spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
        return f"{self.outline(select)}\n\n{physical}"

    def outline(self, select: n.Select) -> str:
        """The tree of the plan; below it, for each table that is not joined, every way to read it and the chosen one."""
        planner = Planner(self.catalog)
        _, plan = planner.select(select)
        lines = [plan.tree()]
        for table, ways, chosen in planner.alternatives:
            lines.append(f"ways to read {table}:")
            lines += [f"  {way}" + (" (chosen)" if way == chosen else "") for way in ways]
        return "\n".join(lines)

    def compare(self, select: n.Select) -> DataFrame:
        """strategy, n_rows, digest, agrees: the same select under each join strategy; its first rows are printed.

        The digest adds up hashes of the rows, so it does not depend on their order. A select with a limit over
        a join may pick other rows under another strategy, which then shows.
        """
        found = []
        for strategy in STRATEGIES:
            frame = self.plan(select, strategy)[0]
            digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]).cast("decimal(38,0)"))
            print(f"# {strategy}")
            show(frame.limit(PRINTED))
            rows, total = frame.agg(F.count("*"), digest).first()
            found.append((strategy, rows, str(total or 0)))
        agreed = [(s, r, d, (r, d) == found[0][1:]) for s, r, d in found]
        return self.spark.createDataFrame(agreed, "strategy string, n_rows long, digest string, agrees boolean")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def insert(self, table: str, rows: Iterable[Sequence]) -> DataFrame:
        return self.catalog.insert(table, rows)

    def register(self, name: str, frame: DataFrame) -> None:
        """Any DataFrame, streams included, as a table of this engine."""
        self.catalog.add(name, frame)


__all__ = ["DialectError", "Engine", "STRATEGIES"]
