"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last one returns the
tokens' digests. SQL cannot express the stages, so there is no oracle; ``tests/llm`` checks them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acreframe.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from acreframe.llm._shared import discard, table, written

ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, learnt from the labels of these documents, does not reject."""
    return toxicity.clean_rows(docs, toxicity.fit_rows(docs, table(spark, sf_dir, "labels")))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_rows(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_rows(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.repeated(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids and of the decoded text of each document."""
    from public_tokenizers import path

    return pieces.token_digests(docs, path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("sentencepiece", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
