"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, line_dedup, mixing, quality, rules, simhash, token_count, topk, toxicity
from .common import table


#: Sites from which on a line counts as boilerplate.
MIN_SITES = 5


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"), max_distance=4, shingle_words=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), seed=42)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.cleaned(table(spark, sf_dir, "documents"), MIN_SITES, counts=("n_lines", "n_removed"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.screened(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threaded(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_chat_formatting": op10_chat_formatting,
}

#: Inner products in whole numbers; DuckDB's list functions give exact ones in doubles.
TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS own, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.own <> q.own)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""

ORACLE_SQL = {
    "op2_mixing": mixing.oracle(42),
    "op4_line_dedup": line_dedup.oracle(MIN_SITES),
    "op7_quality_rules": rules.ORACLE,
    "op9_exact_top_k": TOP_K_SQL,
    "op10_chat_formatting": chat.ORACLE,
}
