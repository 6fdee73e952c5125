"""Scans: files and folders as pages, ground truth, and the stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine.functions import text as T
from passage_engine.schemas import CHUNKS, GROUND_TRUTH_IN, PAGES, POSTINGS, TERM_STATS, VECTORS

FOLDER_TYPES = "*.{pdf,txt,md}"


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path"), "content")


def plain_text(content) -> F.Column:
    """UTF-8 with invalid bytes left out and newlines of one kind."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", ""), "\r\n?", "\n")


def pages(spark: SparkSession, path: str, collection_id: str, pdf: Callable[[bytes], list[str]] | None = None, folder: bool = True, skip_pdf: bool = False) -> DataFrame:
    """Pages of a folder's PDF, text and Markdown files (not of its folders), or of one file of any type.

    ``pdf`` gives the texts of a PDF's pages, '' for a page it can't read; if it fails, the PDF is left out. Without it
    a PDF is an error, unless ``skip_pdf`` says to leave PDFs out. A text file is page 1. In single-file mode the source
    is the collection.
    """
    found = _files(spark, path, FOLDER_TYPES if folder else None)
    source = T.file_name(F.col("path")) if folder else F.lit(None).cast("string")
    is_pdf = T.extension(F.col("path")) == ".pdf"
    if pdf is None and not skip_pdf and (first := found.where(is_pdf).select("path").head()) is not None:
        raise ValueError(f"{first[0]} needs a function that reads PDFs")
    out = found.where(~is_pdf).select(F.lit(collection_id).alias("collection_id"), source.alias("source_file"), F.lit(1).alias("page"), plain_text(F.col("content")).alias("text"))
    if pdf is not None:
        held = found.where(is_pdf).select(F.lit(collection_id).alias("collection_id"), source.alias("source_file"), "content")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for collection, name, content in frame.itertuples(index=False):
                    try:
                        rows += [(collection, name, k, text or "") for k, text in enumerate(pdf(bytes(content)), 1)]
                    except Exception:
                        continue  # a file that can't be read is left out
                yield pd.DataFrame(rows, columns=["collection_id", "source_file", "page", "text"]).astype({"page": "int32"})

        out = out.unionByName(held.mapInPandas(run, PAGES))
    return out


def require_pages(found: DataFrame) -> DataFrame:
    if found.isEmpty():
        raise ValueError("no page could be loaded")
    return found


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers of a JSON-lines file; blank lines are skipped, a malformed one fails."""
    return spark.read.schema(GROUND_TRUTH_IN).option("mode", "FAILFAST").json(path)


def numbered_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_idx, question, truth) in the order of the file."""
    lines = ground_truth(spark, path).coalesce(1)  # a hand-made question set
    return lines.select(F.monotonically_increasing_id().cast("int").alias("question_idx"), "question", F.col("answer").alias("truth"))


def _stored(spark: SparkSession, data: str, name: str, schema: str, collection_id: str | None, pipelines: list[str] | None) -> DataFrame:
    try:
        found = spark.read.schema(schema).parquet(f"{data}/{name}")
    except AnalysisException as e:
        raise FileNotFoundError(f"nothing has been ingested into {data}") from e
    if collection_id is not None:
        found = found.where(F.col("collection_id") == collection_id)
    return found if pipelines is None else found.where(F.col("pipeline").isin(pipelines))


def chunk_store(spark: SparkSession, data: str, collection_id: str | None = None, pipelines: list[str] | None = None) -> DataFrame:
    """Stored chunks; only the folders of the collection and pipelines are read."""
    found = _stored(spark, data, "chunks", CHUNKS, collection_id, pipelines)
    if collection_id is not None and found.isEmpty():
        raise FileNotFoundError(f"{collection_id} has not been ingested")
    return found


def sparse_index(spark: SparkSession, data: str, collection_id: str | None = None, pipelines: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    return _stored(spark, data, "postings", POSTINGS, collection_id, pipelines), _stored(spark, data, "term_stats", TERM_STATS, collection_id, pipelines)


def dense_index(spark: SparkSession, data: str, collection_id: str | None = None, pipelines: list[str] | None = None) -> DataFrame:
    return _stored(spark, data, "chunk_vectors", VECTORS, collection_id, pipelines)
