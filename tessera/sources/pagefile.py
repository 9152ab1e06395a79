"""Single-file databases as a Spark data source, read through the standard library's database module.

Tables are read in ranges of their rowids, of about equal numbers of rows, one range for each partition;
comparisons with constants are pushed into the file's own query, where its indexes serve them, if they mean the
same there. The path must be one that executors can open. Types follow the declared ones; columns of a declared
type without a storage class (dates, booleans, decimals) are text if their first value is, else doubles. A value of
another type raises WrongValueType, or comes as text with the option mismatch = text.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from tessera.errors import PageRead, UnhandledSerial, WrongPageType, WrongValueType
from tessera.shipping import shipped

from .catalog import Catalog, Entry

#: The first bytes of such a file, the beginning of the names of its own objects, and the names of a row's id.
MAGIC = b"SQLite format 3\x00"
OWN = "sqlite_"
ROWID_NAMES = ("rowid", "_rowid_", "oid")
FORMAT = "tessera_pagefile"
#: Rows of a partition.
ROWS = 500_000
OPERATORS = {EqualTo: "=", EqualNullSafe: "is", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def is_database(path: str) -> bool:
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(len(MAGIC)) == MAGIC


def connect(path: str) -> sqlite3.Connection:
    try:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    except sqlite3.Error as e:
        raise PageRead(f"{path}: {e}") from None


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def type_of(declared: str) -> T.DataType | None:
    """The Spark type of a declared type, by the affinity rules of the format; None if the values decide."""
    word = declared.lower()
    if "int" in word:
        return T.LongType()
    if any(w in word for w in ("char", "clob", "text")):
        return T.StringType()
    if "blob" in word or not word:
        return T.BinaryType()
    return T.DoubleType() if any(w in word for w in ("real", "floa", "doub")) else None


def columns_of(path: str, table: str) -> list[tuple[str, T.DataType | None]]:
    """The columns in lower case, and what type_of() says of them."""
    with closing(connect(path)) as db:
        rows = db.execute(f"pragma table_info({quoted(table)})").fetchall()
    if not rows:
        raise WrongPageType(f"{table} is not a table of {path}")
    return [(r[1].lower(), type_of(r[2] or "")) for r in rows]


def schema_of(path: str, table: str) -> T.StructType:
    fields = []
    for name, kind in columns_of(path, table):
        if kind is None:
            with closing(connect(path)) as db:
                first = db.execute(f"select typeof({quoted(name)}) from {quoted(table)} where {quoted(name)} is not null limit 1").fetchone()
            kind = T.StringType() if first and first[0] == "text" else T.DoubleType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


class Range(InputPartition):
    """Rows whose ids lie from low to before high; None is no bound."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


def _value(kind: T.DataType, value: object, name: str, as_text: bool) -> object:
    if value is None:
        return None
    if isinstance(kind, T.LongType) and isinstance(value, int):
        return value
    if isinstance(kind, T.DoubleType) and isinstance(value, (int, float)):
        return float(value)
    if isinstance(kind, T.StringType) and isinstance(value, (str, int, float)):
        return str(value)  # numbers lie in such columns only where the values decide the type
    if isinstance(kind, T.BinaryType) and isinstance(value, bytes):
        return value
    if as_text and isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if not isinstance(value, (int, float, str, bytes)):
        raise UnhandledSerial(f"{name} holds {value!r}")
    raise WrongValueType(f"{name} holds {value!r}, which is not {kind.simpleString()}")


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, as_text: bool):
        self.path, self.table, self.schema, self.as_text = path, table, schema, as_text
        self.conditions: list[tuple[str, str, object]] = []
        columns = columns_of(path, table)
        names = {n for n, _ in columns}
        #: The name that a row's id goes by, if the table has ids and no columns of all their names.
        self.rowid = next((n for n in ROWID_NAMES if n not in names), None)
        #: Columns that compare with constants of a Python type here as they do in the file.
        numbers, text = {T.LongType(), T.DoubleType()}, {T.StringType()}
        self.same = {} if as_text else {n: (int, float) if k in numbers else str for n, k in columns if k in numbers | text}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            operator = OPERATORS.get(type(f))
            same = self.same.get(f.attribute[0]) if operator and len(f.attribute) == 1 else None
            if same and isinstance(f.value, same) and not isinstance(f.value, bool):
                self.conditions.append((f.attribute[0], operator, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Ranges of ROWS rows, by a walk over the rows' ids."""
        if self.rowid is None:
            return [Range(None, None)]
        starts: list[int] = []
        with closing(connect(self.path)) as db:
            text = f"select {self.rowid} from {quoted(self.table)}"
            try:
                found = db.execute(f"{text} order by {self.rowid} limit 1").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]  # a table without rowids
            while found:
                starts.append(found[0])
                found = db.execute(f"{text} where {self.rowid} >= ? order by {self.rowid} limit 1 offset {ROWS}", found).fetchone()
        return [Range(a, b) for a, b in zip(starts, [*starts[1:], None])] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        where = [f"{quoted(c)} {op} ?" + (" collate binary" if isinstance(v, str) else "") for c, op, v in self.conditions]
        values = [v for _, _, v in self.conditions]
        if partition.low is not None:
            where.append(f"{self.rowid} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            where.append(f"{self.rowid} < ?")
            values.append(partition.high)
        text = f"select {', '.join(map(quoted, names))} from {quoted(self.table)}"
        text += f" where {' and '.join(where)}" if where else ""
        text += f" order by {self.rowid}" if partition.low is not None else ""
        with closing(connect(self.path)) as db:
            for row in db.execute(text, values):
                yield tuple(_value(f.dataType, v, f"{self.table}.{f.name}", self.as_text) for f, v in zip(self.schema, row))


class PageFile(DataSource):
    """Options: path, table, mismatch (error or text)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        found = schema_of(self.options["path"], self.options["table"])
        if self.options.get("mismatch") == "text":
            return T.StructType([T.StructField(f.name, T.StringType()) for f in found])
        return found

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema, self.options.get("mismatch") == "text")


def read(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    shipped(spark)
    spark.dataSource.register(PageFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(path=os.path.abspath(path), table=table, **options).load()


def catalog(spark: SparkSession, path: str) -> Catalog:
    """The tables and indexes of the file. Names are as stored; columns are in lower case."""
    path = os.path.abspath(path)
    with closing(connect(path)) as db:
        size = db.execute("pragma page_size").fetchone()[0]
        rows = db.execute("select type, name, tbl_name, rootpage, sql from sqlite_schema where type in ('table', 'index')").fetchall()
        keys = {name: [r[2] for r in db.execute(f"pragma index_info({quoted(name)})")] for kind, name, *_ in rows if kind == "index"}
    found = Catalog(spark, size)
    for kind, name, table, page, sql in rows:
        if kind == "table":
            found.entries[name] = Entry("table", name, table, (sql or "").strip(), lambda t=name: read(spark, path, t), pages=page, fresh=True, internal=name.startswith(OWN))
    for kind, name, table, page, sql in rows:
        if kind == "index" and all(keys[name]):
            found.create_index(name, table, keys[name], sql or "", store=False)
            found.entries[name].internal = name.startswith(OWN)
            found.entries[name].pages = page
    return found
