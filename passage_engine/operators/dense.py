"""Dense index: vectors from an embedder, and cosine retrieval of question vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from passage_engine.operators.sparse import DIGITS, OWN
from passage_engine.operators.topk import check_k, top_k
from passage_engine.providers import Embedder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if a vector is null or has no length; vectors of unequal sizes are an error."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal sizes")).cast("double")).when(n > 0, dot(a, b) / n)
    return F.coalesce(value, F.lit(0.0))


def embed(rows: DataFrame, text: str, embedder: Embedder, tolerant: bool = True) -> DataFrame:
    """Add ``embedding`` and ``norm``. The embedder is made once a partition; a text it fails on gets a null vector, or fails the job."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder.open()
        for frame in frames:
            yield frame.assign(embedding=_vectors(embedder, frame[text].fillna("").tolist(), tolerant))

    return rows.mapInPandas(run, schema).withColumn("norm", norm(F.col("embedding")))


def _vectors(embedder: Embedder, texts: list[str], tolerant: bool) -> list:
    try:
        return [list(map(float, v)) for v in embedder.encode(texts)]
    except Exception:
        if not tolerant:
            raise
        return [_one(embedder, t) for t in texts]


def _one(embedder: Embedder, text: str) -> list[float] | None:
    try:
        return list(map(float, embedder.encode([text])[0]))
    except Exception:
        return None


HELD = 4_000_000  # scores that a task keeps, or makes at once


def retrieve_vectors(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Best k of ``vectors`` (collection_id, pipeline, chunk_ord, embedding, norm) for each of ``questions`` (question_idx, vector, vector_norm).

    A stated question set against all vectors: each task holds the questions, multiplies its vectors with them in blocks and keeps k rows a
    question and space, so that no pair becomes a row.
    """
    check_k(k)
    asked = questions.select("question_idx", "vector", "vector_norm").toPandas()
    kinds = dict(vectors.dtypes) | dict(questions.dtypes)
    schema = f"question_idx {kinds['question_idx']}, collection_id {kinds['collection_id']}, pipeline {kinds['pipeline']}, chunk_ord {kinds['chunk_ord']}, score double"
    held = vectors.select(*OWN, "chunk_ord", "embedding", "norm")
    best = held.mapInPandas(lambda frames: _best(frames, asked, k), schema)
    return top_k(best, ["question_idx", *OWN], k).select("question_idx", *OWN, "rank", "score", "chunk_ord")


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """A row a vector, zeros for a null one."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None:
            if len(v) != size:
                raise ValueError("vectors of unequal sizes")
            out[i] = v
    return out


def _best(frames: Iterator[pd.DataFrame], asked: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Top k of all frames by space and question; ties go by chunk_ord, as in ``top_k``."""
    n = len(asked)
    size = next((len(v) for v in asked["vector"] if v is not None), None)
    if n == 0 or k == 0:
        return
    lengths = asked["vector_norm"].fillna(0.0).to_numpy(float)
    kept: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def shown() -> Iterator[pd.DataFrame]:
        for (collection, pipeline), (score, order) in kept.items():
            yield pd.DataFrame({"question_idx": np.tile(asked["question_idx"].to_numpy(), len(score)), "collection_id": collection, "pipeline": pipeline, "chunk_ord": order.ravel(), "score": score.ravel()})
        kept.clear()

    for frame in frames:
        width = size if size is not None else next((len(v) for v in frame["embedding"] if v is not None), 1)
        against = _matrix(asked["vector"], width).T
        for space, rows in frame.groupby(OWN, dropna=False, sort=False):
            for at in range(0, len(rows), step := max(1, HELD // n)):
                own = rows.iloc[at : at + step]
                by = own["norm"].fillna(0.0).to_numpy(float)[:, None] * lengths
                dots = _matrix(own["embedding"], width) @ against
                score = np.divide(dots, by, out=np.zeros_like(dots), where=by > 0)
                score = np.copysign(np.floor(np.abs(score) * 10**DIGITS + 0.5) / 10**DIGITS, score) + 0.0
                order = np.repeat(own["chunk_ord"].to_numpy()[:, None], n, axis=1)
                key = tuple(None if pd.isna(x) else x for x in space)
                if key in kept:
                    score, order = np.concatenate([kept[key][0], score]), np.concatenate([kept[key][1], order])
                if len(score) > k:  # the k-th score of each question, and all that reach it
                    least = -np.partition(-score, k - 1, axis=0)[k - 1]
                    most = int((score >= least).sum(axis=0).max())
                    near = np.argpartition(-score, most - 1, axis=0)[:most] if most < len(score) else np.broadcast_to(np.arange(len(score))[:, None], score.shape)
                    score, order = np.take_along_axis(score, near, 0), np.take_along_axis(order, near, 0)
                place = np.lexsort((order, -score), axis=0)[:k]
                kept[key] = np.take_along_axis(score, place, 0), np.take_along_axis(order, place, 0)
        if len(kept) * n * k > HELD:
            yield from shown()
    yield from shown()


def retrieve_in_blocks(vectors: DataFrame, questions: DataFrame, k: int, block: int = 1_000) -> DataFrame:
    """``retrieve_vectors`` for any number of ``questions``: blocks of about ``block``, dealt by a hash of question_idx, each held against all vectors in turn."""
    blocks = max(1, -(-questions.count() // block))
    dealt = [questions.where(F.pmod(F.xxhash64("question_idx"), F.lit(blocks)) == n) for n in range(blocks)]
    return reduce(DataFrame.unionByName, [retrieve_vectors(vectors, own, k) for own in dealt])
