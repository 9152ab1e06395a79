"""Removal of boilerplate lines, found by how many distinct sites a line spreads over.

Each line's hash carries a HyperLogLog sketch of its sites; partial sketches merge in the aggregation, so a line
that is on every page costs one for each task. Lines whose estimates are clear of the threshold are decided by
them; lines near the threshold get exact counts of their distinct sites. Of a boilerplate line the first
occurrence stays, all others go. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Binary logarithm of a sketch's registers; its standard error is 1.04 / sqrt(2 ** LG_K), 2.3 %.
LG_K = 11
#: Estimates within so much of the threshold, as a part of it, are counted exactly: four standard errors.
NEAR = 0.1
#: Characters that do not count at either end of a line.
EDGES = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(lines: DataFrame, least: int) -> DataFrame:
    """lines (__key, __site, __id, __row, __pos) -> (__key, __first): lines with at least so many distinct sites, and where each is first."""
    spread = lines.groupBy("__key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__site", LG_K)).alias("__spread"), F.min(F.struct("__id", "__row", "__pos")).alias("__first")
    )
    found = durable(spread.where(F.col("__spread") >= least * (1 - NEAR)))
    near = F.col("__spread") <= least * (1 + NEAR)
    exact = lines.join(found.where(near).select("__key"), "__key", "left_semi").groupBy("__key").agg(F.count_distinct("__site").alias("__sites")).where(F.col("__sites") >= least)
    return found.where(~near).select("__key", "__first").union(found.join(exact, "__key", "left_semi").select("__key", "__first"))


def cleaned(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text; all columns stay, in order.

    A line is a stretch between line feeds; spaces, tabs and carriage returns at its ends do not count. Blank
    lines are never boilerplate. A line is boilerplate if it occurs on min_sites distinct sites or more; a NULL
    site is none. Its first occurrence (by id, then by the text's hash, then by place) stays; rows with the same
    id and text are one occurrence. A NULL text becomes empty; a text may become empty, its row stays. counts
    names two columns to add: lines before, and lines removed. An empty table gives an empty result; names of
    other columns do not matter.
    """
    names = docs.columns
    row = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col(f"`{id_col}`").alias("__id"), row.alias("__row"))
    lines = docs.select(
        F.col(f"`{id_col}`").alias("__id"), row.alias("__row"), F.col(f"`{site_col}`").cast("string").alias("__site"), F.posexplode(_lines(F.col(f"`{text_col}`"))).alias("__pos", "__line")
    )
    bare = F.btrim(F.col("__line"), F.lit(EDGES))
    lines = durable(lines.where(bare != "").select("__id", "__row", "__pos", "__site", F.unhex(F.md5(bare.cast("binary"))).alias("__key")))
    known = durable(boilerplate(lines, min_sites))
    gone = (
        lines.join(known, "__key")
        .where(~F.struct("__id", "__row", "__pos").eqNullSafe(F.col("__first")))
        .groupBy(F.col("__id").alias("__of"), F.col("__row").alias("__hit"))
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    met = held.join(gone, (F.col("__row") == F.col("__hit")) & F.col("__id").eqNullSafe(F.col("__of")), "left")
    all_lines = _lines(F.col(f"__doc.`{text_col}`"))
    left = F.filter(all_lines, lambda _, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.coalesce(F.col(f"__doc.`{text_col}`"), F.lit(""))).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"__doc.`{c}`").alias(c) for c in names]
    if counts:
        columns += [F.size(all_lines).cast("long").alias(counts[0]), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(counts[1])]
    return met.select(*columns)


def oracle(min_sites: int) -> str:
    """DuckDB SQL for the result of the query over documents."""
    return f"""
WITH l AS (
  SELECT doc_id, source, line, i, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT bare, min(doc_id) AS first_doc FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {min_sites}),
f AS (SELECT k.bare, k.first_doc, min(l.i) AS first_i FROM k JOIN l ON l.bare = k.bare AND l.doc_id = k.first_doc GROUP BY ALL),
m AS (
  SELECT l.doc_id, l.line, l.i, f.bare IS NOT NULL AND NOT (l.doc_id = f.first_doc AND l.i = f.first_i) AS gone
  FROM l LEFT JOIN f ON l.bare = f.bare)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM m GROUP BY doc_id"""
