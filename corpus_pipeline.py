"""A corpus pipeline: judge, deduplicate, mix and tokenize ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import bpe, dedup, mixing, neardup, quality
from oddsloom.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from ``labels``."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return dedup.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return neardup.drop_near(docs, weights="count")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256, exact."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_filter), ("exact", exact_dedup), ("near", near_dedup), ("mix", mix_sources), ("bpe", encode)]

#: Training, darts and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written before the next begins.

    Null texts count as empty: they are judged, are copies of each other, and encode to no tokens.  Rows
    with a null or repeated doc_id go through as rows; of repeated rows the stages for copies keep what
    their operators say.  Texts of any length are read whole by every stage.  Columns besides doc_id, text and
    source are carried along, whatever their names, up to the last stage.  An empty table gives an empty
    result; without labels to learn from, the classifier is untrained and its score decides as ever.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
