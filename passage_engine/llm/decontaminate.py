"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is the set of its 5-word shingles (ASCII letters folded); an item of fewer words is its whole word
sequence. Items of one run length are partitioned by set size, a partition holding the sizes above half of its bound
``u`` up to ``u`` (1, 2, 4, 8, ...). In a partition every item is sketched by its ``floor((1 - threshold) * u) + 1``
least shingle hashes, and one lookup of a document's window hashes tells the partitions that each of them may be in. A
document that holds ``threshold`` of an item of ``n`` shingles misses at most ``floor((1 - threshold) * n)`` of its
sketch; items with fewer hits are no candidates, and a document with fewer windows than a partition's least item needs
is not held against it. So a document of any length finds every item that it holds, by sketches as short as the item's
partition allows. Candidates are verified by exact containment of word tuples.

The items are a stated query set held against all documents, in blocks of about ``BLOCK_BYTES`` of item text whose
sketches and shingles are sent to the workers; a larger benchmark is searched block by block, and a block's broadcast
is released once its pairs are written. Null texts and texts without words hold nothing and, as items, are held by
nothing. Repeated items and rows each give their own pairs. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

SIZE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long"


@dataclass
class Partition:
    """Sketches of the items of one run length with more than ``bound / 2`` and at most ``bound`` shingles."""

    bound: int
    least: int  #: shingles that a document needs to hold the smallest of them
    keys: np.ndarray  #: the sketch hashes in order
    items: list[list[int]]  #: the items of each


class Items:
    """One block of items: partitions by run length and set size, and the exact shingles."""

    CELLS = 1 << 22

    def __init__(self, rows: list[tuple[int, str | None]], size: int, threshold: float):
        self.size = size
        hashes, self.sets, self.ids, self.need = C.WordHashes(), [], [], []
        sketch: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        smallest: dict[tuple[int, int], int] = {}
        for item_id, text in rows:
            w = (text or "").encode().lower().split()
            if not w:
                continue
            run = min(size, len(w))
            h, _ = hashes.of([w])
            own = C.shingle_set(h, run)
            place = run, (len(own) - 1).bit_length()
            sketched = own[: self.missed(1 << place[1], threshold) + 1]
            for x in sketched.tolist():
                sketch[place][x].append(len(self.ids))
            smallest[place] = min(len(own), smallest.get(place, len(own)))
            self.ids.append(item_id)
            self.need.append(len(sketched) - self.missed(len(own), threshold))
            self.sets.append((run, frozenset(tuple(w[i : i + run]) for i in range(len(w) - run + 1)), threshold))
        #: By run length and number of the partition.
        self.partitions: dict[int, dict[int, Partition]] = defaultdict(dict)
        #: By run length: of each value of a hash's low bits, the partitions (as bits) that have such a hash.
        self.cells: dict[int, np.ndarray] = {}
        for (run, p), found in sorted(sketch.items()):
            keys = np.array(sorted(found), np.uint64)
            self.partitions[run][p] = Partition(1 << p, smallest[run, p] - self.missed(smallest[run, p], threshold), keys, [found[int(x)] for x in keys])
        for run, own in self.partitions.items():
            n = sum(len(x.keys) for x in own.values())
            cells = np.zeros(min(self.CELLS, 1 << max(16, (16 * n).bit_length())), np.uint32)
            for p, x in own.items():
                cells[x.keys & np.uint64(len(cells) - 1)] |= np.uint32(1 << p)
            self.cells[run] = cells

    @staticmethod
    def missed(n: int, threshold: float) -> int:
        """Shingles of ``n`` that a document which holds the item may miss."""
        return n - math.ceil(threshold * n - 1e-9)

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> dict[int, set[int]]:
        """Items by row for which the row has as many sketch hashes as it must."""
        hits: dict[tuple[int, int], int] = defaultdict(int)
        for run, own in self.partitions.items():
            w, cells = C.windows(h, run), self.cells[run]
            may = cells[w & np.uint64(len(cells) - 1)]
            some = np.flatnonzero(may)
            row = np.searchsorted(starts, some, "right") - 1
            some, row = (x[some + run <= starts[row + 1]] for x in (some, row))
            may, n_windows = may[some], starts[row + 1] - starts[row] - run + 1
            for p, part in own.items():
                here = np.flatnonzero(((may >> np.uint32(p)) & np.uint32(1)).astype(bool) & (n_windows >= part.least))
                k = np.searchsorted(part.keys, w[some[here]])
                k[k == len(part.keys)] = 0
                same = part.keys[k] == w[some[here]]
                for r, x in set(zip(row[here][same].tolist(), k[same].tolist(), strict=True)):
                    for i in part.items[x]:
                        hits[r, i] += 1
        out: dict[int, set[int]] = defaultdict(set)
        for (r, i), n in hits.items():
            if n >= self.need[i]:
                out[r].add(i)
        return out

    def verify(self, w: list[bytes], found: set[int]) -> Iterator[tuple[int, int, int]]:
        grams: dict[int, set] = {}
        for i in sorted(found):
            run, own, threshold = self.sets[i]
            if run not in grams:
                grams[run] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
            shared = len(own & grams[run])
            if shared >= threshold * len(own) - 1e-9:
                yield self.ids[i], len(own), shared


def _blocks(benchmark: DataFrame, size: int, threshold: float) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of the benchmark, and each of them, sent to the workers. Equal items are dealt like others."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).head()[0] or 0
    n_blocks = max(1, math.ceil(2 * total / BLOCK_BYTES))
    if n_blocks > 1:
        items = C.pin(items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))), "items")

    def blocks() -> Iterator[Broadcast]:
        for k in range(n_blocks):
            own = items.where(F.col("block") == k) if n_blocks > 1 else items
            block = [tuple(r) for r in own.select("item_id", "text").orderBy("item_id", "text").collect()]  # BLOCK_BYTES or so
            yield spark.sparkContext.broadcast(Items(block, size, threshold))

    return n_blocks, blocks()


def _held(own: Items, hashes: C.WordHashes, batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[int, int, int]]]:
    lists = [x.lower().split() for x in C.as_bytes(batch.column("text"))]
    for r, found in own.candidates(*hashes.of(lists)).items():
        for x in own.verify(lists[r], found):
            yield r, x


def _pairs(texts: DataFrame, key: str, sent: Broadcast) -> DataFrame:
    """(key, item_id, n_shingles, n_shared) of each row of ``texts`` (key, text) and item of the block it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for batch in C.text_blocks(batches):
            ids = batch.column(key).to_pylist()
            if rows := [(ids[r], *x) for r, x in _held(sent.value, hashes, batch)]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [key, "item_id", "n_shingles", "n_shared"])

    return texts.mapInArrow(run, PAIRS.replace("doc_id", key))


def _by_block(texts: DataFrame, key: str, blocks: Iterator[Broadcast]) -> DataFrame:
    """Pairs of several blocks: each block's are written, then its broadcast is released."""
    found = []
    for sent in blocks:
        found.append(C.pin(_pairs(texts, key, sent), "pairs"))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for each document and item it holds; one pass over ``docs`` a block of items."""
    C.bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_blocks, blocks = _blocks(benchmark, size, threshold)
    return _pairs(texts, "doc_id", next(blocks)) if n_blocks == 1 else _by_block(texts, "doc_id", blocks)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item.

    With one block, rows are judged as they pass, without a join. With several, the rows are written once, numbered, and
    the numbers of those that hold an item of any block are taken out.
    """
    C.bound_batches(docs.sparkSession)
    n_blocks, blocks = _blocks(benchmark, size, threshold)
    if n_blocks > 1:
        (row,) = C.fresh(docs.columns, "row_no")
        numbered = C.pin(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        held = _by_block(numbered.select(row, F.col("text").cast("string").alias("text")), row, blocks)
        return numbered.join(held.select(row).distinct(), row, "left_anti").select(*docs.columns)
    sent = next(blocks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for batch in C.text_blocks(batches):
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, _ in _held(sent.value, hashes, batch)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
