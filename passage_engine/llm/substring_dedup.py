"""Exact substring removal behind a count-min prefilter.

A window is a run of ``size`` words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id.

The documents are dealt once, by a hash of doc_id and text, into *blocks* of bounded size; that exchange serves all
passes. Rows of one doc_id may lie in several blocks: blocks are compared by the least doc_id of a window alone.

1. Each block sketches its distinct windows: ``DEPTH`` rows of hashed cells, sorted and delta-packed, cut by cell
   range. Equal ranges of all blocks meet and are merged to saturating counts; each block gets one bit for each of
   its cells back: whether the merged count is two or more. Cells over-count, so no repeated window is lost.
2. Blocks send only windows estimated as repeated (a 96-bit hash and the least doc_id in the block), by hash range.
   Exact grouping finds each window's least doc_id; one bit each comes back: whether another block has a smaller one.
3. Each block marks the words covered by windows with a smaller doc_id in the block or elsewhere.

A window sends one entry a block however many documents hold it, so a passage in a third of all documents stays
small. No sketch is broadcast or collected: the merged sketch lives in ranges of a 48th of the corpus's words, between
2**16 and 2**26 entries (``Plan``); blocks grow with the square root of the corpus from 1.5 to 64 MB. Beyond about
20 GB the number of ranges grows, and beyond 1 TB that of blocks, not their sizes. Null texts have no words; repeated rows share a doc_id
and don't remove each other; a null doc_id is smaller than all others. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

DEPTH = 2
CELLS = "block long, part long, n long, cells binary, twice binary"
BITS = "block long, kind int, part long, bits binary"
NULL = np.iinfo(np.int64).min


class Plan:
    """Sizes that all passes share: cells in a sketch row, bits of a cell range, number of hash ranges."""

    def __init__(self, n_words: int, size: int):
        self.size = size
        entries = int(min(max(n_words / 48, 1 << 16), 1 << 26))
        self.ranges = max(1, math.ceil(n_words / entries))
        self.width_bits = min(56, max(16, math.ceil(math.log2(max(1, 6 * n_words)))))
        self.range_bits = max(0, self.width_bits - max(0, math.ceil(math.log2(self.ranges))))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return C.mix(h ^ np.uint64(0x6C62272E07BB0142 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - self.width_bits)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, as byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


class Block:
    """Windows of one block of documents. ``first``: where each window of ``key`` order begins a new hash."""

    def __init__(self, frame: pd.DataFrame, plan: Plan):
        frame = frame.sort_values(["doc_id", "text"], kind="stable", na_position="first")
        self.plan = plan
        self.raw = frame["doc_id"].tolist()
        self.ids = np.array([NULL if pd.isna(x) else int(x) for x in self.raw], np.int64)
        self.words = [x.encode().split() if isinstance(x, str) else [] for x in frame["text"]]
        h, self.starts = C.WordHashes().of(self.words)
        w, w2 = C.windows(h, plan.size), C.windows(h, plan.size, 0xC2B2AE3D27D4EB4F)
        at = np.arange(len(w))
        doc = np.searchsorted(self.starts, at, "right") - 1
        inside = at + plan.size <= self.starts[doc + 1]
        self.at, self.doc, h, h2 = at[inside], doc[inside], w[inside], (w2[inside] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.at, h2, h)) if len(h) else np.empty(0, np.int64)
        self.at, self.doc, h, h2 = self.at[order], self.doc[order], h[order], h2[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        self.group = np.cumsum(new) - 1
        #: Of each distinct window: its hash, the least doc_id (documents are in order of doc_id), and whether two rows hold it.
        self.h, self.h2, self.least = h[new], h2[new], self.ids[self.doc[new]]
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(h) - 1]]).astype(np.int64) if len(h) else np.empty(0, np.int64)
        self.several = self.ids[self.doc[last]] != self.least

    def sketch(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, offsets, counted twice, windows' cell numbers within all of the row's) for each sketch row's cell ranges."""
        for row in range(DEPTH):
            cells, back = np.unique(self.plan.cells(self.h, row), return_inverse=True)
            part = (cells >> np.uint64(self.plan.range_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                base = np.uint64(int(part[a]) << self.plan.range_bits)
                yield row, int(part[a]), a, b, cells[a:b] - base, back

    def repeated(self, bits: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Distinct windows that every sketch row counts as repeated."""
        out = np.ones(len(self.h), bool)
        for row in range(DEPTH):
            cells, back = np.unique(self.plan.cells(self.h, row), return_inverse=True)
            part = (cells >> np.uint64(self.plan.range_bits)).astype(np.int64)
            flag = np.zeros(len(cells), bool)
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                flag[a:b] = np.unpackbits(np.frombuffer(bits[row, int(part[a])], np.uint8), count=b - a).astype(bool)
            out &= flag[back]
        return out

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.plan.ranges) >> np.uint64(32)).astype(np.int64)

    def removed(self, elsewhere: np.ndarray) -> Iterator[tuple]:
        """Result rows; ``elsewhere``: distinct windows that another block has with a smaller doc_id."""
        bad = elsewhere[self.group] | (self.ids[self.doc] > self.least[self.group])
        cover = np.zeros(int(self.starts[-1]) + self.plan.size + 1, np.int32)
        np.add.at(cover, self.at[bad], 1)
        np.add.at(cover, self.at[bad] + self.plan.size, -1)
        gone = np.cumsum(cover)[: int(self.starts[-1])] > 0
        for k, w in enumerate(self.words):
            out = gone[self.starts[k] : self.starts[k + 1]]
            kept = w if not out.any() else [x for x, g in zip(w, out.tolist(), strict=True) if not g]
            yield self.raw[k], len(w), int(out.sum()), b" ".join(kept)


def _sketches(plan: Plan):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, rows = int(frame["block"].iloc[0]), []
        own = Block(frame, plan)
        counted: dict[int, np.ndarray] = {}
        for row, part, a, b, offsets, back in own.sketch():
            if row not in counted:  # two windows in one cell, or a window of two documents
                counted[row] = np.bincount(back, 1 + own.several.astype(np.int64)) > 1
            rows.append((block, part * DEPTH + row, b - a, pack(offsets), zlib.compress(np.packbits(counted[row][a:b]).tobytes(), 1)))
        return pd.DataFrame(rows, columns=["block", "part", "n", "cells", "twice"])

    return run


def _merge(plan: Plan):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << plan.range_bits, np.uint8)
        own = [unpack(x) for x in frame["cells"]]
        for at, n, twice in zip(own, frame["n"], frame["twice"], strict=True):
            counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(zlib.decompress(twice), np.uint8), count=int(n)), 2)
        bits = [zlib.compress(np.packbits(counts[at] > 1).tobytes(), 1) for at in own]
        return pd.DataFrame({"block": frame["block"], "kind": np.int32(0), "part": frame["part"], "bits": bits})

    return run


def _bits(frame: pd.DataFrame, kind: int) -> dict:
    return {int(p): zlib.decompress(b) for k, p, b in zip(frame["kind"], frame["part"], frame["bits"], strict=True) if k == kind}


def _estimated(own: Block, found: pd.DataFrame) -> np.ndarray:
    return own.repeated({(p % DEPTH, p // DEPTH): b for p, b in _bits(found, 0).items()})


def _entries(plan: Plan):
    """Second pass of a block: the windows estimated as repeated, by hash range."""

    def run(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame):
            own = Block(frame, plan)
            at = np.flatnonzero(_estimated(own, found))
            part = own.range_of(own.h[at])  # hashes are in order, so ranges are
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                k = at[a:b]
                least = own.least[k].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
                rows.append((int(frame["block"].iloc[0]), int(part[a]), b - a, own.h[k].astype("<u8").tobytes() + own.h2[k].astype("<u4").tobytes(), zlib.compress(least, 1)))
        return pd.DataFrame(rows, columns=["block", "part", "n", "cells", "twice"])

    return run


def _group(frame: pd.DataFrame) -> pd.DataFrame:
    """Exact groups of one hash range: whether another block has a window in a document with a smaller doc_id."""
    h, h2, least = [], [], []
    for n, cells, ids in zip(frame["n"], frame["cells"], frame["twice"], strict=True):
        h.append(np.frombuffer(cells, "<u8", int(n)))
        h2.append(np.frombuffer(cells, "<u4", int(n), 8 * int(n)))
        least.append(np.ascontiguousarray(np.frombuffer(zlib.decompress(ids), np.uint8).reshape(8, -1).T).view("<i8").ravel())
    ends = np.cumsum([len(x) for x in h])
    h, h2, least = np.concatenate(h), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((least, h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = least[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(h), bool)
    smaller[order] = first < least[order]
    bits = [zlib.compress(np.packbits(smaller[b - int(n) : b]).tobytes(), 1) for n, b in zip(frame["n"], ends, strict=True)]
    return pd.DataFrame({"block": frame["block"], "kind": np.int32(1), "part": frame["part"], "bits": bits})


def _result(plan: Plan, texts: bool):
    def run(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame):
            own = Block(frame, plan)
            elsewhere, exact = np.zeros(len(own.h), bool), _bits(found, 1)
            at = np.flatnonzero(_estimated(own, found))
            part = own.range_of(own.h[at])
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                elsewhere[at[a:b]] = np.unpackbits(np.frombuffer(exact[int(part[a])], np.uint8), count=b - a).astype(bool)
            rows = [(None if pd.isna(i) else int(i), n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None) for i, n, gone, kept in own.removed(elsewhere)]
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"doc_id": "Int64"})

    return run


def remove_substrings(docs: DataFrame, size: int = 13, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of each row of ``docs``; kept words joined by one space."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text")), F.count("*")).head()
    n_bytes, n_docs = total[0] or 0, total[1]
    block_bytes = min(max(2e6 * math.sqrt(n_bytes / 1e9), 1.5e6), 64e6)
    n_blocks = max(1, min(n_docs, math.ceil(n_bytes / block_bytes)))
    plan = Plan(max(1, n_bytes // 6), size)
    # by text as well, so that rows that share an id, or have none, don't gather in one block
    dealt = source.withColumn("block", F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(n_blocks)))
    block = dealt.groupBy("block")
    merged = block.applyInPandas(_sketches(plan), CELLS).groupBy("part").applyInPandas(_merge(plan), BITS)
    entries = block.cogroup(merged.groupBy("block")).applyInPandas(_entries(plan), CELLS)
    exact = entries.groupBy("part").applyInPandas(_group, BITS)
    out = block.cogroup(merged.unionByName(exact).groupBy("block")).applyInPandas(_result(plan, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
