"""Sparse index: TF-IDF postings in long form, and cosine retrieval by an equi-join on terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.functions import text as T
from passage_engine.operators.topk import check_k, top_k
from passage_engine.sources import tables

OWN = ["collection_id", "pipeline"]
DIGITS = 6  # scores are rounded before they are ranked, so that the order of a sum doesn't decide a tie


def term_frequency(chunks: DataFrame, stop_words: frozenset[str] | None = None, own: list[str] = OWN) -> DataFrame:
    """A row for each term of a chunk, counted inside the chunk's row."""
    return chunks.select(*own, "chunk_ord", F.explode(T.term_counts(F.col("text"), stop_words)).alias("t")).select(*own, "chunk_ord", "t.term", "t.tf")


def term_stats(tf: DataFrame, chunks: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Document frequency and smoothed inverse document frequency of each term."""
    df = tf.groupBy(*own, "term").agg(F.count("*").alias("df"))
    n = chunks.groupBy(*own).agg(F.count("*").alias("n"))  # a row a collection and pipeline
    return df.join(n, own).select(*own, "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def postings(tf: DataFrame, stats: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Weights of the terms of each chunk, as unit vectors. ``tf`` is read twice: norms come from a hash aggregate, so no posting is sorted by chunk."""
    raw = tf.join(stats, [*own, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(*own, "chunk_ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, [*own, "chunk_ord"]).withColumn("weight", F.col("w") / F.col("norm")).select(*own, "chunk_ord", "term", "tf", "weight")


def chunk_norms(tf: DataFrame, stats: DataFrame, own: list[str] = OWN) -> DataFrame:
    raw = tf.join(stats, [*own, "term"])
    return raw.groupBy(*own, "chunk_ord").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))


def question_vectors(questions: DataFrame, stats: DataFrame, stop_words: frozenset[str] | None = None, own: list[str] = OWN) -> DataFrame:
    """Unit vectors of the questions in each collection and pipeline; terms unknown there don't count."""
    each = questions.select("question_idx", F.explode(T.terms(F.col("question"), stop_words)).alias("term"))
    tf = each.groupBy("question_idx", "term").agg(F.count("*").alias("tf"))
    raw = stats.join(tf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*own, "question_idx")))
    return raw.withColumn("q", F.col("w") / norm).select(*own, "question_idx", "term", "q", "idf")


def retrieve(index: DataFrame, stats: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, stop_words: frozenset[str] | None = None, own: list[str] = OWN) -> DataFrame:
    """(question_idx, collection_id, pipeline, rank, score, chunk_ord) of the k best chunks of each question.

    Chunks without a common term score 0 and fill up: as ties go by chunk_ord, only the first k of a collection can
    be among them, so k padding rows a question stand for all, and no question meets every chunk.
    """
    check_k(k)
    dots = index.join(question_vectors(questions, stats, stop_words, own), [*own, "term"]).groupBy("question_idx", *own, "chunk_ord").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return ranked(dots, chunks, questions, k, own)


def retrieve_unindexed(tf: DataFrame, stats: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, stop_words: frozenset[str] | None = None, own: list[str] = OWN) -> DataFrame:
    """The same from term frequencies (a table): only the questions' terms are weighted one by one, and divided by the chunk's
    norm after they are summed. The question vectors are written first, so that their size decides how they are joined."""
    check_k(k)
    asked = tables.pin(question_vectors(questions, stats, stop_words, own), "asked")
    dots = tf.join(asked, [*own, "term"]).groupBy("question_idx", *own, "chunk_ord").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))
    scored = dots.join(chunk_norms(tf, stats, own), [*own, "chunk_ord"])
    return ranked(scored.withColumn("score", F.col("dot") / F.col("norm")), chunks, questions, k, own)


def ranked(dots: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, own: list[str] = OWN) -> DataFrame:
    """Top k of scored chunks, filled up with zeros."""
    group = ["question_idx", *own]
    dots = dots.select(*group, "chunk_ord", F.round("score", DIGITS).alias("score"))
    best = top_k(dots, group, k).drop("rank")
    pad = chunks.where(F.col("chunk_ord") < k).select(*own, "chunk_ord").crossJoin(questions.select("question_idx"))
    rows = best.unionByName(pad.select(*group, "chunk_ord", F.lit(0.0).alias("score")))
    merged = rows.groupBy(*group, "chunk_ord").agg(F.max("score").alias("score"))
    return top_k(merged, group, k).select("question_idx", *own, "rank", "score", "chunk_ord")


def require_terms(stats: DataFrame) -> None:
    """A corpus without a term can't be indexed."""
    if stats.isEmpty():
        raise ValueError("no chunk has a term that isn't a stop word")
