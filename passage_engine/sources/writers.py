"""Sinks: the partitioned index store, CSV reports, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine.schemas import METRICS

PARTITIONS = ["collection_id", "pipeline"]


def store(df: DataFrame, data: str, name: str, order: list[str]) -> None:
    """Write a table of the index; a collection's pipeline that comes again replaces what was there, others stay."""
    store_dealt(df.repartition(*PARTITIONS, F.pmod(F.xxhash64(order[0]), F.lit(8))), data, name, order)


def store_dealt(df: DataFrame, data: str, name: str, order: list[str]) -> None:
    """The same for rows of which each task has a few collections already: nothing is dealt again."""
    out = df.sortWithinPartitions(*PARTITIONS, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{data}/{name}")


def summary_csv(summary: DataFrame, path: str) -> None:
    """pipeline and metrics, a row a pipeline; no value is an empty cell."""
    _csv(summary.select("pipeline", *METRICS).orderBy("pipeline"), path)


def per_question_csv(rows: DataFrame, path: str) -> None:
    names = ["pipeline", "question_idx", "question", "answer", "ground_truth", "metric", "value"]
    _csv(rows.select(*names).orderBy("pipeline", "question_idx", "metric"), path)


def _csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, nulls included; a file for each task, as one task can't sort and write all."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
