"""Scores of answers: word overlap with the truth, and judged metrics with nulls left out of means."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from passage_engine.functions import text as T
from passage_engine.providers import Judge
from passage_engine.schemas import METRICS


def proxy_scores(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """Jaccard similarity of each answer to its question's truth; questions meet by number."""
    return answers.join(truths.select("question_idx", "truth"), "question_idx").withColumn("proxy", T.jaccard(F.col("answer"), F.col("truth")))


def proxy_report(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """(pipeline, proxy_similarity_mean); 0 for a pipeline whose answers meet no truth."""
    pipelines = answers.select("pipeline").distinct()
    means = proxy_scores(answers, truths).groupBy("pipeline").agg(F.avg("proxy").alias("m"))
    return pipelines.join(means, "pipeline", "left").select("pipeline", F.coalesce("m", F.lit(0.0)).alias("proxy_similarity_mean"))


def is_valid():
    """An answer and contexts, none of them blank."""
    return T.has_text(F.col("answer")) & (F.coalesce(F.size("contexts"), F.lit(0)) > 0) & F.coalesce(F.forall("contexts", T.has_text), F.lit(False))


def diagnostics(answers: DataFrame) -> DataFrame:
    empty = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    return answers.groupBy("pipeline").agg(F.count("*").alias("entries"), F.count_if(empty).alias("empty_contexts"), F.count_if(~T.has_text(F.col("answer"))).alias("empty_answers"), F.count_if(is_valid()).alias("valid"))


def judged(answers: DataFrame, truths: DataFrame, judge: Judge) -> DataFrame:
    """(question_idx, pipeline, question, answer, truth, one column a metric) of all answers; only valid ones are judged, the others' metrics are null."""
    rows = answers.join(truths.select("question_idx", "truth"), "question_idx").select("question_idx", "pipeline", "question", "answer", "truth", "contexts", is_valid().alias("valid"))
    schema = StructType([*rows.drop("contexts", "valid").schema.fields, *[StructField(m, DoubleType()) for m in METRICS]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_judge(judge, r) if r.valid else {} for r in frame.itertuples(index=False)]
            yield frame.drop(columns=["contexts", "valid"]).assign(**{m: pd.array([x.get(m) for x in found], "Float64") for m in METRICS})

    return rows.mapInPandas(run, schema)


def _judge(judge: Judge, row) -> dict[str, float | None]:
    try:
        found = judge.judge(row.question, row.answer, list(row.contexts), row.truth or "")
    except Exception:
        return {}
    return {k: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) for k, v in found.items()}


def metric_rows(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Long form: a row for each question, pipeline and metric; what is no number is null."""
    held = scores.select("pipeline", "question_idx", "question", "answer", F.col("truth").alias("ground_truth"), *[T.finite(F.col(m)).alias(m) for m in metrics])
    return held.unpivot(["pipeline", "question_idx", "question", "answer", "ground_truth"], list(metrics), "metric", "value")


def metric_summary(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(pipeline, a mean for each metric): nulls are left out, and a metric without a value is null."""
    return rows.groupBy("pipeline").pivot("metric", list(metrics)).agg(F.avg("value"))


def overall(summary: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(pipeline, average): mean of a pipeline's metric means, null without any."""
    return summary.unpivot(["pipeline"], list(metrics), "metric", "value").groupBy("pipeline").agg(F.avg("value").alias("average"))


def status(chunks: DataFrame) -> DataFrame:
    """Chunks, pages and files of each collection and pipeline, counted by page, by file and over files."""
    own = ["collection_id", "pipeline"]
    pages = chunks.groupBy(*own, "source_file", "page").agg(F.count("*").alias("n"))
    files = pages.groupBy(*own, "source_file").agg(F.sum("n").alias("n"), F.count("page").alias("pages"))
    named = F.col("source_file").isNotNull()
    return files.groupBy(*own).agg(F.sum("n").alias("chunks"), F.coalesce(F.sum(F.when(named, F.col("pages"))), F.lit(0)).alias("pages"), F.count("source_file").alias("files"))
