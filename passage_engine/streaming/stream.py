"""Chunking of files as they arrive. The chunkers hold no state, so the same plan serves streams; the index's
document frequencies do not add up batch by batch, so it is made again over the stored chunks after each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine.config import DEFAULTS, Defaults
from passage_engine.functions import text as T
from passage_engine.operators import chunking
from passage_engine.sources.readers import plain_text

FILES = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, folder: str, collection_id: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{txt,md}").load(folder)
    return files.select(F.lit(collection_id).alias("collection_id"), T.file_name(F.col("path")).alias("source_file"), F.lit(1).alias("page"), plain_text(F.col("content")).alias("text"))


def write_chunks(pages: DataFrame, out: str, checkpoint: str, defaults: Defaults = DEFAULTS):
    """Append the chunks of all pages that have arrived; a restart goes on where it stopped."""
    return chunking.all_classic(pages, defaults).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
