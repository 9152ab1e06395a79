"""Tables and indexes by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, FileNotFound, PageFull, Span, TableNotFound, WrongValueType

from .storage import fresh_path

TYPES = {"integer": T.LongType(), "int": T.LongType(), "text": T.StringType(), "real": T.DoubleType(), "blob": T.BinaryType()}
#: Columns that carry a row's place in its table; never part of the table's own columns.
PLACE = ("__file", "__place")
ROWID = "__rowid"
#: Rows that one insert may carry through the driver; and bytes of a row group of an index, which a seek reads as a whole.
INSERTED, GROUP = 1_000_000, 8 << 20


def declared(kind: T.DataType) -> str:
    """The dialect's name of a type, or Spark's own where the dialect has none."""
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(kind, T.StringType):
        return "text"
    return "blob" if isinstance(kind, T.BinaryType) else kind.simpleString()


@dataclass
class Entry:
    """A table, or an index: its keys in order and, in a column called index, the rowid of each row."""

    kind: str
    name: str
    table: str
    sql: str
    load: Callable[[], DataFrame]
    columns: tuple[str, ...] = ()
    placed: Callable[[Sequence[str] | None], DataFrame] | None = None
    """The table with the PLACE columns, if its rows have an order; whole, or those rows that the given files hold."""
    pages: int = 0
    #: Whether each use needs a frame of its own: a Python source keeps the filters that one plan pushed.
    fresh: bool = False
    #: Whether the object is one of the file format's own, which lists of tables leave out.
    internal: bool = False


class Catalog:
    """Names are matched exactly first, then without regard to case."""

    def __init__(self, spark: SparkSession, page_size: int = 0):
        self.spark = spark
        self.page_size = page_size
        self.entries: dict[str, Entry] = {}
        self._frames: dict[str, DataFrame] = {}

    # -- opening -----------------------------------------------------------------------------------------------

    @classmethod
    def of_directory(cls, spark: SparkSession, path: str) -> Catalog:
        """A table for each NAME.parquet (file or folder) in the directory, in whatever store Spark reads."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(where):
            raise FileNotFound(f"{path} does not exist")
        catalog = cls(spark)
        for name in sorted(status.getPath().getName() for status in store.listStatus(where)):
            if name.endswith(".parquet"):
                catalog.add_parquet(name.removesuffix(".parquet"), f"{path.rstrip('/')}/{name}")
        return catalog

    def add_parquet(self, name: str, path: str) -> None:
        self.entries[name] = self._stored("table", name, name, "", path)

    def _stored(self, kind: str, name: str, table: str, sql: str, path: str, columns: Sequence[str] = ()) -> Entry:
        spark = self.spark

        def placed(files: Sequence[str] | None = None) -> DataFrame:
            raw = spark.read.parquet(*([path] if files is None else files))
            return raw.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))

        return Entry(kind, name, table, sql, lambda: spark.read.parquet(path), tuple(columns), placed)

    def add(self, name: str, frame: DataFrame, sql: str = "", table: str | None = None) -> None:
        """Any DataFrame, streams included, as a table."""
        self._frames.pop(name, None)
        self.entries[name] = Entry("table", name, table or name, sql, lambda: frame)

    # -- lookup ------------------------------------------------------------------------------------------------

    def find(self, name: str, span: Span | None = None) -> Entry:
        entry = self.entries.get(name)
        if entry is None:
            entry = next((e for k, e in self.entries.items() if k.lower() == name.lower()), None)
        if entry is None:
            raise TableNotFound(f"no table or index is called {name}", span)
        return entry

    def frame(self, name: str, span: Span | None = None) -> DataFrame:
        entry = self.find(name, span)
        if entry.fresh:
            return entry.load()
        if entry.name not in self._frames:
            self._frames[entry.name] = entry.load()
        return self._frames[entry.name]

    def with_rowid(self, name: str) -> DataFrame:
        """The table and ROWID: places from 1, through its files in the order of their paths."""
        entry = self.find(name)
        if entry.placed is None:
            return self.frame(name).select("*", (F.monotonically_increasing_id() + 1).alias(ROWID))
        rows = entry.placed()
        if len(rows.inputFiles()) <= 1:
            return rows.withColumn(ROWID, F.col(PLACE[1]) + 1).drop(*PLACE)
        sizes = rows.groupBy(PLACE[0]).agg((F.max(PLACE[1]) + 1).alias("__size"))
        before = Window.orderBy(PLACE[0]).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        starts = sizes.select(PLACE[0], F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
        return rows.join(starts, PLACE[0]).withColumn(ROWID, F.col("__start") + F.col(PLACE[1]) + 1).drop(*PLACE, "__start")

    def indexes(self, table: str, columns: Iterable[str]) -> list[Entry]:
        """Indexes of the table that hold all the columns, at any position."""
        wanted = {c.lower() for c in columns}
        return [e for e in self.entries.values() if e.kind == "index" and e.table == self.find(table).name and wanted <= {c.lower() for c in e.columns}]

    # -- definitions -------------------------------------------------------------------------------------------

    def create_table(self, name: str, columns: Sequence[tuple[str, str]], sql: str) -> DataFrame:
        schema = T.StructType([T.StructField(c, TYPES[k]) for c, k in columns])
        self.add(name, self.spark.createDataFrame([], schema), sql)
        return self.frame(name)

    def insert(self, name: str, rows: Iterable[Sequence]) -> DataFrame:
        """The table with the rows after its own. Values must have the types of their columns, or be None."""
        old = self.frame(name)
        checked = []
        for row in map(tuple, rows):
            if len(checked) >= INSERTED:
                raise PageFull(f"one insert takes {INSERTED} rows at most; more are registered as a table")
            if len(row) != len(old.schema):
                raise WrongValueType(f"{name} has {len(old.schema)} columns, a row has {len(row)} values")
            for field, value in zip(old.schema, row):
                if value is not None and not _fits(field.dataType, value):
                    raise WrongValueType(f"{value!r} is not {declared(field.dataType)} as {name}.{field.name} is")
            checked.append(row)
        added = self.spark.createDataFrame(checked, old.schema)
        entry = self.find(name)
        self.add(entry.name, old.unionByName(added), entry.sql)
        return self.frame(entry.name)

    def create_index(self, name: str, table: str, columns: Sequence[str], sql: str, span: Span | None = None, store: bool = True) -> DataFrame:
        """Registers the keys and rowids of the table, in order of the keys, under the index's name.

        Of a table in files they are stored, sorted, when the index is made: a seek reads the row groups whose
        statistics let the keys be there. Other tables change, or have indexes of their own: theirs are views.
        """
        entry = self.find(table, span)
        known = {c.lower(): c for c in self.frame(table).columns}
        for c in columns:
            if c.lower() not in known:
                raise ColumnNotFound(f"{table} has no column {c}", span)
        keys = [known[c.lower()] for c in columns]
        order = [*[F.col(f"`{k}`") for k in keys], F.col("index")]

        def rows() -> DataFrame:
            return self.with_rowid(entry.name).select(*[F.col(f"`{k}`") for k in keys], F.col(ROWID).alias("index"))

        self._frames.pop(name, None)
        if store and entry.placed is not None and "index" not in known:
            path = fresh_path(self.spark, "index")
            rows().repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP).parquet(path)
            self.entries[name] = self._stored("index", name, entry.name, sql, path, keys)
        else:
            self.entries[name] = Entry("index", name, entry.name, sql, lambda: rows().orderBy(*order), tuple(keys), fresh=entry.fresh)
        return self.frame(name)

    # -- metadata ----------------------------------------------------------------------------------------------

    def sql_of(self, entry: Entry) -> str:
        if entry.sql:
            return entry.sql
        columns = ", ".join(f"{f.name} {declared(f.dataType)}" for f in self.frame(entry.name).schema)
        return f"create table {entry.name}({columns})"

    def listing(self) -> DataFrame:
        """type, name, tbl_name, rootpage, sql of every entry."""
        rows = [(e.kind, e.name, e.table, e.pages or i + 1, self.sql_of(e)) for i, e in enumerate(self.entries.values())]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage long, sql string")


def _fits(kind: T.DataType, value: object) -> bool:
    if isinstance(kind, T.IntegralType):
        return isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, T.FractionalType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return isinstance(value, (bytes, bytearray)) if isinstance(kind, T.BinaryType) else True


def placed_order() -> list[Column]:
    return [F.col(c).asc() for c in PLACE]
