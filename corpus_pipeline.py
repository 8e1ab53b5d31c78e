"""A training corpus from raw documents in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, langid, mixing, quality, simhash
from tidelog.storage import cut, made, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rule and are no outliers of their language and source; null and empty texts go."""
    return quality.stage(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text fits a language that was learned; null texts and texts without a letter go."""
    return langid.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest doc_id; rows without an id stay."""
    return simhash.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never; a null source is a source of its own."""
    return mixing.stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for each row; null and empty texts have no tokens."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The outlier estimates, language models, components and balanced samples are iterative; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written to the shared folder and read again.

    What a stage leaves in that folder is removed once its result is written, but for the last stage's. Nulls, empty
    texts, repeated rows and columns of any name are handled as the stages say; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        since = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
            release(spark, since, docs)
    return docs
