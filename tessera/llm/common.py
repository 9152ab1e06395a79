"""What the operators share: durable cuts of the lineage, and vectorized maps over texts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.shipping import shipped

#: Rows turned into Python strings at a time; Spark bounds an Arrow batch by its bytes.
SLICE = 256

#: Bytes of an Arrow batch, where the session does not set them: they exist in the JVM and in Python at once.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

#: Words are separated by these six ASCII characters only.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_tables: list[str] = []


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and the table's path: a cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def mark() -> int:
    """How many tables operators of this process have written so far; for forget()."""
    return len(_tables)


def forget(spark: SparkSession, since: int = 0, but: Sequence[str] = ()) -> None:
    """Removes the tables that operators of this process have written since a mark, but for some paths; results that read them end with them."""
    for path in _tables[since:]:
        if path not in but:
            dropped(spark, path)


class Scratch:
    """Tables in the shared folder that go together, once what they lead to is written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        found, path = written(df)
        self.paths.append(path)
        return found

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            dropped(spark, self.paths.pop())


def durable(df: DataFrame) -> DataFrame:
    return written(df)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _tables:
        _tables.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str) -> Column:
    """CRC-32 of an id written as text; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def arrow_ready(spark: SparkSession) -> None:
    """Code on the executors, and batches of a bounded size."""
    shipped(spark)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def released() -> None:
    """Gives freed memory back to the machine: a Python worker stays while stages without Python run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    added: str,
    make: Callable[[], Callable[[list], Sequence]],
    drop_where_false: str | None = None,
) -> DataFrame:
    """A row for each row of docs: the columns keep, then the columns of the DDL string added.

    make() is called once a task and gives a function from a list of texts (NULL as None) to the added
    columns' values in order; an attribute done of it is called at the task's end. drop_where_false names an added boolean column: rows where it is false go,
    and the column too.
    """
    new = T._parse_datatype_string(added)
    kept = [docs.schema[c] for c in keep]
    source = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in new]
    names = [f.name for f in new]
    flag = names.index(drop_where_false) if drop_where_false else None
    out_new = [f for i, f in enumerate(new) if i != flag]
    schema = T.StructType([*kept, *out_new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = work(part.column(0).to_pylist())
                columns = [pa.array(v, type=f.type) for v, f in zip(values, arrow)]
                rest = [part.column(i + 1) for i in range(len(kept))]
                mask = None
                if flag is not None:
                    mask = columns.pop(flag)
                fields = [part.schema.field(i + 1) for i in range(len(kept))] + [f for i, f in enumerate(arrow) if i != flag]
                result = pa.RecordBatch.from_arrays([*rest, *columns], schema=pa.schema(fields))
                yield result if mask is None else result.filter(mask)
        if done := getattr(work, "done", None):
            done()
        del work
        released()

    arrow_ready(docs.sparkSession)
    return source.mapInArrow(run, schema)


__all__ = ["SLICE", "WORD", "shared_dir", "written", "durable", "dropped", "forget", "mark", "Scratch", "table", "id_crc", "map_texts", "arrow_ready", "released"]
