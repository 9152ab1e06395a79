"""From raw documents to token ids: quality, repeated lines, near-duplicates, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, quality, simhash
from tessera.llm.common import forget, mark, table, written
from tessera.llm.queries import MIN_SITES


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of sf_dir, does not reject.

    NULL and empty texts are scored as one empty line; repeated rows stay or go together; without labels all score the same.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat across sites, but for a line's first occurrence; n_chars follows.

    A NULL text becomes empty; rows stay even if all their lines go; rows of equal id and text are one occurrence.
    """
    found = line_dedup.cleaned(docs, MIN_SITES)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id (NULL first); of equal rows one.

    Texts without words, NULL too, are alike. Links are similarities of five-word shingles of 0.8 or more, all of them.
    """
    return simhash.deduplicated(docs, shingle_words=5, alike=0.8)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares of tokens.

    A NULL source or language is a value of its own; NULL and empty texts are drawn with their cell; equal ids go together.
    """
    return mixing.mixed(docs, seed=42, keep=docs.columns).where("__kept").drop("__kept")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them; NULL is an empty text, repeated rows stay."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL has no classifier, fingerprints or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the result of each stage before is written to the shared folder and read again.

    A stage's own tables and the result before it go once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = mark()
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        forget(spark, before, [path])
    return STAGES[-1][1](spark, docs, sf_dir)
