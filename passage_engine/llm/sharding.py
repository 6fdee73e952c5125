"""Contiguous shards of near equal bytes.

Documents stand in order of doc_id. Byte and row prefix sums come from the totals of ranges of doc_id, shifted
by the running total of the ranges before. A document goes to the shard in which its middle byte falls when
all bytes are cut at equal targets, so shards are contiguous and off by at most the size of a document at each cut.

Size: UTF-8 bytes of the text plus 1; null has no bytes. Null doc_ids come first; rows sharing a doc_id stand in
order of their texts' CRC-32 and then of the input. Other columns are not read for the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

SHARDS = 16


def place(sized: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add shard and slot to ``sized`` (pinned: row, doc_id, size, text_crc32)."""
    total = sized.agg(F.sum("size")).head()[0] or 1
    summed = C.prefix_sums(sized.withColumn("__one", F.lit(1).cast("long")), "doc_id", {"size": "__bytes", "__one": "__row"}, ties=["text_crc32", "row"])
    middle = F.col("__bytes").cast("decimal(38,0)") * 2 + F.col("size")
    cut = summed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total)).cast("int")))
    cut = C.pin(cut, "cut")
    first = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # a row a shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first")).drop("__one", "__bytes", "__row", "__first")


def _sized(docs: DataFrame, *keep) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keep)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``."""
    out = place(C.pin(_sized(docs), "sizes"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents to ``path`` as one folder a shard, in order within each file; the assignment is returned."""
    whole = C.pin(_sized(docs, F.struct("*").alias("doc")), "docs")
    placed = C.pin(place(whole.select("row", "doc_id", "size", "text_crc32"), shards), "placed")
    out = whole.select("row", "doc").join(placed.select("row", "shard", "slot"), "row").select("shard", "slot", "doc.*")
    out.repartitionByRange(C.n_partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
