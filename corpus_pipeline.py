"""A training-data pipeline over ``documents``: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage reads all that the one before it kept, as Parquet; all but the last return the columns of ``documents``.
Nulls, empty texts, repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passage_engine.llm import common as C
from passage_engine.llm import decontaminate, mixing, near_dedup, quality_rules, token_store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and policy v1."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by 5-word shingles: that with the least doc_id; one of repeated rows."""
    return near_dedup.keep_first(docs, size=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, C.load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes, a row for each document and pass over its source."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.read_digests(spark, token_store.write_store(docs, C.new_path(spark, "store")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("token_ids", token_ids),
]

#: Neither pseudorandom mixing nor tokenization can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = C.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.pin(docs, name)
    return docs
