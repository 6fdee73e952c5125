"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training reads at most ``SAMPLE`` labelled documents (those with the least hash of doc_id, of the folds that are
not held out; a documented bound) and only their statistics reach the driver. Statistics are cut into ``BINS``
quantile bins; each level of a tree is grown from one histogram of gradients over (node, feature, bin). The trees
are complete and flattened into three arrays; scoring walks all rows of a batch through a tree at once.

Scores read nothing but the text. Null and empty texts are scored by their (zero) statistics. Without labels, or
with labels of one kind, every score is the mean label (0.5 without any). Repeated labels of a document count by
their mean; repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST = 20_000, 64, 60, 4, 0.2, 20
FEATURES = ("words", "word_bytes", "distinct_words", "top_word", "repeated_pairs", "runs", "lines", "line_bytes", "repeated_lines", "upper", "digits", "marks", "symbols", "bars", "short_words", "long_words", "sentence_ends", "spaces")

_CLASSES = np.zeros((7, 256), np.float64)
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#*$%&<>@^~{}[]=+\\_", b"|", b".", b" \t\n\r\x0b\x0c")):
    _CLASSES[_row, list(_bytes)] = 1


def statistics(text: bytes) -> list[float]:
    """The ``FEATURES`` of one text, as ratios where a size would only repeat the number of words."""
    n = len(text)
    w = text.split()
    m = len(w)
    if not m:
        return [0.0] * len(FEATURES)
    upper, digits, marks, symbols, bars, ends, spaces = (_CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n).tolist()
    counts = Counter(w)
    pairs = len(set(zip(w, w[1:], strict=False)))
    runs = sum(map(bytes.__eq__, w, w[1:]))
    lines = [x for x in re.split(rb"\n", text) if x.strip()]
    sizes = list(map(len, w))
    return [
        float(np.log1p(m)), sum(sizes) / m, len(counts) / m, max(counts.values()) / m, 1 - pairs / max(1, m - 1), runs / m, len(lines) / m, n / len(lines), 1 - len(set(lines)) / len(lines),
        upper, digits, marks, symbols, bars, sum(s <= 2 for s in sizes) / m, sum(s >= 12 for s in sizes) / m, ends, spaces,
    ]


class Trees:
    """Flattened complete trees: node k of a tree has the children 2k+1 and 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss of labels ``y`` in [0, 1]."""
    inner = (1 << DEPTH) - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    features, cuts, values = [], [], []
    if len(y) and y.min() < y.max():
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        f_count, raw = x.shape[1], np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)  # within its level
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                width, first = 1 << level, (1 << level) - 1
                key = ((node[:, None] * f_count + np.arange(f_count)) * BINS + binned).ravel()
                size = width * f_count * BINS
                hist = [np.bincount(key, np.repeat(v, f_count) if v is not None else None, size).reshape(width, f_count, BINS).cumsum(2) for v in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :, -1:] for v in hist]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = -np.inf
                for f, e in enumerate(edges):
                    gain[:, f, len(e) :] = -np.inf
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] > 1e-6:
                        feature[first + k], cut[first + k] = f, edges[f][b]
                node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            gs, hs = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
            value = -RATE * gs / (hs + 1)
            raw += value[node]
            features.append(feature)
            cuts.append(cut)
            values.append(value)
    shape = (len(features), inner)
    return Trees(base, np.array(features, np.int64).reshape(shape), np.array(cuts).reshape(shape), np.array(values).reshape(len(values), 1 << DEPTH))


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by the CRC-32 of the id as text; a null id is in no fold and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labels that aren't held out, ``sample`` documents at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    chosen = own.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_blocks(batches):
            x = [statistics(t) for t in C.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y double, x array<double>")
    # of several texts of one id, that with the least statistics: no chance in it
    own = rows.groupBy("id").agg(F.min(F.struct("y", "x")).alias("v"))
    found = sorted((r[0], r[1]["y"], tuple(r[1]["x"])) for r in own.collect())  # ``sample`` rows of statistics
    return fit(np.array([r[2] for r in found]).reshape(len(found), len(FEATURES)), np.array([r[1] for r in found]))


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_blocks(batches):
            x = np.array([statistics(t) for t in C.as_bytes(batch.column("text"))]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
