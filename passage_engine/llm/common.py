"""Shared parts of the corpus operators: pinned tables, blocks of texts, word hashes, prefix sums, union-find.

Every table that an operator reads more than once is *pinned*: written into the folder that the session names in
``spark.checkpoint.dir`` and read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.sources.tables import NO_CHILDREN, new_path, pin, remove_pinned, shared_dir  # noqa: F401

U64 = np.uint64
#: Words are runs of anything but the six ASCII white-space bytes; ``bytes.split()`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: ASCII letters; only these change case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row: no filter above is pushed below, where it would evaluate what it reads once more."""
    return df.select(F.inline(F.array(F.struct("*"))))


def words(text: Column) -> Column:
    """All words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1))


# ---------------------------------------------------------------- blocks of texts in Python workers


#: Bytes of rows that go to a Python worker at once, where the session allows more.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python workers by bytes: by rows alone, long texts make them as large as they like.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` in the session, if it is larger.
    """
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Helper column names that none of ``columns`` has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text (one row at least), to bound memory."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen of late that have at most ``MOST`` bytes."""

    LIMIT, MOST = 300_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.MOST:
            self[word] = value
        return value

    def of(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and where each list starts (one more entry than lists)."""
        if len(self) > self.LIMIT:
            self.clear()
        starts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=starts[1:])
        out = np.empty(int(starts[-1]), U64)
        get = self.__getitem__
        for k, x in enumerate(lists):
            out[starts[k] : starts[k + 1]] = np.fromiter(map(get, x), U64, len(x))
        return out, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries, in about log2(size) passes; runs may span documents."""
    if len(h) < size:
        return np.empty(0, U64)
    powers: dict[int, np.ndarray] = {1: mix(h)}
    w = 1
    while 2 * w <= size:
        p, f = powers[w], U64(pow(base, w, 1 << 64))
        powers[2 * w] = p[: len(p) - w] * f + p[w:]
        w *= 2
    out, done = powers[w], w
    while done < size:
        while done + w > size:
            w //= 2
        more = powers[w][done:]
        n = min(len(out), len(more))
        out = out[:n] * U64(pow(base, w, 1 << 64)) + more[:n]
        done += w
    return mix(out[: len(h) - size + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of one document; fewer words than ``size`` make one run."""
    return np.unique(windows(h, min(size, len(h)))) if len(h) else np.empty(0, U64)


# ---------------------------------------------------------------- prefix sums


def prefix_sums(df: DataFrame, key: str, values: dict[str, str], group: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Add, for each ``values`` item (column: new name), the sum over the rows before in order of ``key``.

    The rows are dealt into contiguous ranges of ``key`` (nulls first) by approximate quantiles; each range's
    total comes from one partial aggregation, the totals' running sum shifts the sums inside the ranges. No task
    sees more than one range, so a hot ``group`` does not gather in one task. ``df`` must be pinned.
    """
    spark = df.sparkSession
    n = max(1, min(2_000, 4 * n_partitions(spark)))
    cuts = sorted({float(x) for x in df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    bounds = F.array(*[F.lit(x) for x in cuts]) if cuts else None
    k = F.col(key)
    part = F.lit(0) if bounds is None else F.when(k.isNull(), 0).otherwise(_bisect(cuts, k))
    ranged = df.withColumn("__part", part)
    groups = [F.col(group)] if group else []
    totals = ranged.groupBy("__part", *groups).agg(*[F.sum(c).alias(f"__t_{o}") for c, o in values.items()])
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__part").alias("__p"), *([F.col(group).alias("__g")] if group else []), *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__s_{o}") for o in values.values()])
    on = F.col("__part") == F.col("__p")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("__g"))
    inside = Window.partitionBy("__part", *groups).orderBy(F.col(key).asc_nulls_first(), *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"__l_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, o in values.items()})
    out = local.join(shifts if group else F.broadcast(shifts), on, "left")  # without a group: a row for each range, 2,000 at most
    return out.withColumns({o: F.col(f"__l_{o}") + F.col(f"__s_{o}") for o in values.values()}).drop("__part", "__p", "__g", *[f"__{a}_{o}" for o in values.values() for a in "ls"])


def _bisect(cuts: list[float], k: Column) -> Column:
    """Number of cuts below ``k``, as a tree of comparisons."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k > cuts[mid], node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(cuts))


# ---------------------------------------------------------------- union-find


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table by distributed union-find: (node, root), for nodes that aren't roots.

    Each round hooks every node to its least smaller neighbour, halves the paths until all point at a root, and
    contracts the edges to roots; the number of roots with edges at least halves, so the rounds are logarithmic.
    A root is its component's least node. All joins look up a unique key in a pinned table.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    left = pin(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        parent = pin(left.groupBy("u").agg(F.min("v").alias("v")), "parent")
        while True:
            # two steps up at once; a path that was longer than one step may go on
            one, two = parent.select(F.col("u").alias("v"), F.col("v").alias("v1")), parent.select(F.col("u").alias("v1"), F.col("v").alias("v2"))
            up = parent.join(one, "v", "left").join(two, "v1", "left")
            parent = pin(up.select("u", F.coalesce("v2", "v1", "v").alias("v"), F.col("v2").isNotNull().alias("moved")), "parent")
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("u", "v")
        p = parent.select(F.col("u").alias("v"), F.col("v").alias("vv"))
        if labels is None:
            labels = parent
        else:
            labels = pin(labels.join(p, "v", "left").select("u", F.coalesce("vv", "v").alias("v")).unionByName(parent), "labels")
        q = parent.select("u", F.col("v").alias("uu"))
        moved = left.join(q, "u").select(F.col("uu").alias("x"), "v").join(p, "v", "left").select("x", F.coalesce("vv", "v").alias("y"))
        left = pin(moved.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.select(F.col("u").alias("node"), F.col("v").alias("root"))
