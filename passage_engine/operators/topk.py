"""The first k rows of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k can't be negative")


def top_k(scored: DataFrame, groups: list[str], k: int, order=None) -> DataFrame:
    """Add ``rank`` from 1; ties in score go by chunk_ord. Spark keeps k rows a group before the shuffle."""
    check_k(k)
    own = Window.partitionBy(*groups).orderBy(*(order or [F.desc("score"), F.asc("chunk_ord")]))
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
