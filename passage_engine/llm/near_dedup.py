"""MinHash near-duplicate groups by one-permutation hashing.

1. Each text becomes its set of ``size``-word shingles (ASCII letters folded; fewer words make one), one permutation of which is cut into
   ``BANDS * ROWS`` bins; empty bins are filled by optimal densification (each probes bins in a fixed pseudorandom
   order until it meets a full one). Texts with equal sets collapse to their least doc_id.
2. Bins are read in bands; equal bands put sets into a bucket. A bucket's least id is the hub of a star: its edges
   to the others are candidates, as many as members, never all pairs.
3. Candidates are confirmed on full shingle sets (100 * intersection >= 80 * union); union-find over the confirmed
   links gives components. Members of a bucket that are still in different components meet other hubs, and what is
   then open goes through an exact prefix filter (``similarity``), so no link within a bucket is lost to the star.

A pair of similarity 0.8 misses all bands with probability (1 - 0.8**5)**32 < 4e-6. Nothing is capped.
Null or empty texts have no shingles and link with nothing. Repeated rows fall together; a null doc_id takes the
component of its text, null if it stands alone. Rows sharing a doc_id are one node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.llm import common as C
from passage_engine.llm import similarity

BANDS, ROWS = 32, 5
PROBES = 512
SIGNED = "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


@lru_cache(4)
def _probes(bins: int) -> np.ndarray:
    """For each bin, the bins it asks in turn when empty; the same everywhere."""
    x = np.arange(bins * PROBES, dtype=np.uint64).reshape(bins, PROBES)
    return (C.mix(x + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.int64)


def one_permutation(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Signature of a non-empty sorted set of hashes: the least of each bin, empty bins densified."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # grows with the hash, so the first of a bin is its least
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    full, out = np.zeros(bins, bool), np.zeros(bins, np.uint64)
    own = at[first].astype(np.int64)
    full[own], out[own] = True, hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = _probes(bins)[empty]
        hit = full[asked]
        k = hit.argmax(1)
        took = asked[np.arange(len(empty)), k]
        none = ~hit[np.arange(len(empty)), k]
        took[none] = own[empty[none] % len(own)]
        out[empty] = out[took]
    return out


def signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bins = C.WordHashes(), bands * rows
        salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in C.text_blocks(batches):
            h, starts = hashes.of([x.lower().split() for x in C.as_bytes(batch.column("text"))])
            n = batch.num_rows
            sizes, fps, sigs = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, bins), np.uint64)
            for k in range(n):
                own = C.shingle_set(h[starts[k] : starts[k + 1]], size)
                sizes[k] = len(own)
                if len(own):
                    sigs[k] = one_permutation(own, bins)
                    fps[k] = np.bitwise_xor.reduce(C.mix(own)), np.add.reduce(C.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            key = np.repeat(salt[None], n, 0)
            for r in range(rows):
                key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, r::rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(C.signed(key).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(C.signed(fps[:, 0])), pa.array(C.signed(fps[:, 1])), lists], schema=_SIGNED)

    return sign


def shingler(size: int):
    """Makes the function from texts to their shingle sets; one for each task."""

    def make() -> similarity.Shingler:
        hashes = C.WordHashes()

        def sets(column: pa.Array) -> list[np.ndarray]:
            h, starts = hashes.of([x.lower().split() for x in C.as_bytes(column)])
            return [C.shingle_set(h[a:b], size) for a, b in zip(starts, starts[1:], strict=False)]

        return sets

    return make


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; links: shingle sets with a similarity of ``percent`` or more."""
    C.bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.pin(source.mapInArrow(signer(size, bands, rows), SIGNED), "signed")
    sets = C.pin(signed.where("n_shingles > 0").groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    # one row a document; only the least of each group of equal sets carries its bands
    nodes = signed.join(sets, ["fp_a", "fp_b"], "left").withColumn("rep", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
    lead = (F.col("n_shingles") > 0) & (F.col("rep") == F.col("doc_id"))
    nodes = C.pin(nodes.select("doc_id", "n_shingles", "rep", F.when(lead, F.col("bands")).alias("bands")), "nodes")

    member = nodes.where("bands is not null").select(F.explode("bands").alias("key"), F.col("rep").alias("id"))

    def texts_of(ids: DataFrame) -> DataFrame:
        return source.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")

    labels = similarity.components(member, texts_of, shingler(size), percent)
    out = nodes.select("doc_id", "n_shingles", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs``, with all columns, without near duplicates: of each component the row with the least doc_id, once.

    Of rows with the same doc_id and text, the one whose columns have the least hash stays.
    """
    own, text, nth = C.fresh(docs.columns, "kept_id", "kept_text", "nth")
    kept = C.pin(near_duplicates(docs, **how).where("kept").select(F.col("doc_id").alias(own)).distinct(), "kept")
    rows = docs.withColumn(text, F.xxhash64("text")).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    same = Window.partitionBy(own, text).orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)
