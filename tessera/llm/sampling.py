"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc

#: Characters of all texts of a training sample, at most: it has to fit the driver.
CHARS = 16_000_000


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether an id is in the part that no label is learnt from; false for NULL."""
    return F.coalesce(id_crc(column) % parts == part, F.lit(False))


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, most_chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(__text, __label): labelled documents outside the held-out part.

    most bounds the labels: those of the smallest digests of the id are taken, so the sample is the same for
    every run and order of rows; most_chars bounds the characters of their texts together: in that order, a
    document that no longer fits is passed over. Rows with a NULL id or label teach nothing; ids with labels of
    both kinds neither.
    """
    one = (
        labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label"))
        .where("__id is not null and __label is not null")
        .where(~held_out("__id", parts, part))
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"), F.max("__label").alias("__other"))
        .where("__label = __other")
    )
    digest = F.md5(F.col("__id").cast("string").cast("binary"))
    chosen = one.orderBy(digest, "__id").limit(most).select("__id", "__label", digest.alias("__digest"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    sizes = texts.select("__id", F.length(F.coalesce("__text", F.lit(""))).alias("__n")).join(F.broadcast(chosen), "__id").groupBy("__id", "__label", "__digest").agg(F.sum("__n").alias("__n"))
    fit, room = [], most_chars
    for row in sorted(sizes.collect(), key=lambda r: (r["__digest"], r["__id"])):  # most rows at most
        if row["__n"] <= room:
            room -= row["__n"]
            fit.append((row["__id"], row["__label"]))
    known = docs.sparkSession.createDataFrame(fit, one.select("__id", "__label").schema)
    return texts.join(F.broadcast(known), "__id").select("__text", "__label")
