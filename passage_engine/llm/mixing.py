"""Mixing sources to target weights.

Each source's documents, in order of doc_id, form one stream of words that is packed into blocks of ``block``
words (the last may be short). The target of a source is its weight's share of all words, at most ``most`` times
its size, the excess reshared. Its slots are the whole passes over its blocks that fit, and as many more blocks
as come nearest. For each output shard the counts by source are drawn from a multinomial over what the sources
have left, so shards are random mixtures while every total is met. Slot j of a source is block P(j mod n) of pass
j div n, P a keyed pseudorandom permutation of the block indices for each pass; slots and blocks meet by index.

Sources stay in a table, however many they are: targets come from a few rounds of aggregates over it, and sources are
drawn in groups of ``GROUP``. The driver draws a shard's counts by group (a row for each group and shard), an executor
a group's counts by source, which together is a draw by source. Slots are numbered by the executors.

The same input gives the same mixture, whatever its files: repeated doc_ids go in order of a hash of the text. Null texts
and texts without words have size 0 and take nothing; repeated rows are documents of their own; a null source is a
source and comes last; null doc_ids come first in a stream. Other columns go along unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

BLOCK, SHARDS, MOST, GROUP = 32, 16, 3, 4_096
WEIGHTS = (1, 2, 3)
CHUNK = 1 << 16
#: Sources that are broadcast, a row each; a longer list is joined by shuffling.
SENT = 100_000
SLOTS = "shard int, slot long, source_no int, pass int, block long"


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; ``with_targets`` of plain lists."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        for i in free:
            out[i] = float(most * sizes[i]) if i in over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def in_order(sources: DataFrame) -> DataFrame:
    """``sources`` (name, source_size) with ``source_no`` by code point, null last: sorted, and numbered by partition."""
    placed = C.pin(sources.orderBy(F.col("name").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    offsets, at = [], 0
    for k, n in placed.groupBy(part.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect():  # a row a partition
        offsets.append((k, at))
        at += n
    shift = placed.sparkSession.createDataFrame(offsets, "k long, shift long")
    own = placed.withColumn("k", part).join(F.broadcast(shift), "k")  # a row a partition
    return own.select("name", "source_size", (F.col("shift") + F.col("place").bitwiseAND((1 << 33) - 1)).cast("int").alias("source_no"))


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` with ``target``: each round fixes the sources whose share would be above ``most`` times their size.

    A round is one aggregate; the share of a unit of weight grows from round to round, until no source is above it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    rows = C.pin(sources.select("*", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("top")).where("source_size is not null"), "weighed")
    total = float(rows.agg(F.sum("source_size")).head()[0] or 0)
    unit, free = 0.0, None
    while True:
        fixed = F.col("weight") * unit > F.col("top") if unit else F.col("source_size") == 0
        got = rows.agg(F.sum(F.when(fixed, F.col("top"))), F.sum(F.when(~fixed, F.col("weight"))), F.count(F.when(~fixed, 1))).head()
        if not got[2] or got[2] == free:
            break
        free, unit = got[2], (total - (got[0] or 0.0)) / got[1]
    share = F.col("weight") * unit
    return rows.select("name", "source_no", "source_size", F.when(share > F.col("top"), F.col("top")).otherwise(share).alias("target"))


def slot_counts(sizes: list[int], wanted: list[float], block: int) -> list[int]:
    """Slots of each source: whole passes, and the blocks that bring it nearest to its target."""
    out = []
    for size, t in zip(sizes, wanted, strict=True):
        n = -(-size // block)
        passes = int(t // size) if size else 0
        out.append(passes * n + min(n, round((t - passes * size) / block)) if size else 0)
    return out


def draw(slots: list[int], shards: int, seed: int | list[int], totals: list[int] | None = None) -> np.ndarray:
    """counts[shard, source]: multinomial draws from what is left; columns sum to ``slots``, rows to ``totals`` (default: equal)."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, np.int64), []
    for k in range(shards):
        need, got = int(left.sum()) // (shards - k) if totals is None else totals[k], np.zeros(len(left), np.int64)
        while need:
            more = np.minimum(rng.multinomial(need, left / left.sum()), left)
            got, left, need = got + more, left - more, need - int(more.sum())
        out.append(got)
    return np.array(out).reshape(shards, len(left))


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``j`` under a pseudorandom permutation of range(n): a four-round Feistel network, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), j.astype(np.uint64)
    todo = np.ones(len(j), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            a, b = b, a ^ (C.mix(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


RUNS = "shard int, source_no int, n long, lo long, hi long, at long"


def _share(seed: int, shards: int, block: int):
    """Runs of slots (at most ``CHUNK`` each) of one group's sources, from the group's counts by shard and where they start."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("source_no")
        sizes, slots = table.column("source_size").to_pylist(), table.column("slots").to_pylist()
        totals, starts, numbers = table.column("counts")[0].as_py(), table.column("starts")[0].as_py(), table.column("source_no").to_pylist()
        counts = draw(slots, shards, [seed, numbers[0] // GROUP], totals)
        rows, lo = [], np.zeros(len(sizes), np.int64)
        for shard in range(shards):
            at = starts[shard]
            for k, c in enumerate(counts[shard].tolist()):
                rows += [(shard, numbers[k], -(-sizes[k] // block), int(lo[k]) + a, int(lo[k]) + min(c, a + CHUNK), at + a) for a in range(0, c, CHUNK)]
                at, lo[k] = at + c, lo[k] + c
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["shard", "source_no", "n", "lo", "hi", "at"])

    return run


def slot_runs(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(shard, source_no, n, lo, hi, at): slots ``lo`` to ``hi`` of a source of ``n`` blocks are slots of the shard from ``at`` on."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = slot_counts(batch.column("source_size").to_pylist(), batch.column("target").to_pylist(), block)
            numbers = batch.column("source_no").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x // GROUP for x in numbers], pa.int32()), batch.column("source_no"), batch.column("source_size"), pa.array(slots, pa.int64())], ["group", "source_no", "source_size", "slots"])

    own = sources.where("source_size > 0").select("source_no", "source_size", "target")
    grouped = C.pin(own.mapInArrow(counted, "group int, source_no int, source_size long, slots long"), "slots")
    groups = sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("slots")).collect())  # a row for GROUP sources
    counts = draw([g[1] for g in groups], shards, seed)
    starts = np.cumsum(counts, 1) - counts
    table = [(g[0], counts[:, k].tolist(), starts[:, k].tolist()) for k, g in enumerate(groups)]
    shares = sources.sparkSession.createDataFrame(table, "group int, counts array<long>, starts array<long>")
    return grouped.join(shares, "group").groupBy("group").applyInArrow(_share(seed, shards, block), RUNS)


def _fill(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                j = np.arange(r["lo"], r["hi"], dtype=np.int64)
                passes = j // r["n"]
                block = np.empty(len(j), np.int64)
                for p in np.unique(passes):
                    at = passes == p
                    block[at] = permuted(j[at] % r["n"], r["n"], (seed * 1_000_003 + r["source_no"]) * 1_009 + int(p))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), r["shard"], np.int32)), pa.array(r["at"] + j - r["lo"]), pa.array(np.full(len(j), r["source_no"], np.int32)), pa.array(passes.astype(np.int32)), pa.array(block)], ["shard", "slot", "source_no", "pass", "block"])

    return run


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, doc_id, source, tie, size) of ``docs`` and the columns ``keep``: a row number, a hash of the text, the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_blocks(batches):
            n = pa.array([len(x.split()) for x in C.as_bytes(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n], [*names, "size"])

    C.bound_batches(docs.sparkSession)
    names = ["row", "doc_id", "source", "tie", *keep]
    own = [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie")]
    source = docs.select(*own, *dict.fromkeys(["text", *keep]))
    schema = source.select(*names).schema.add("size", "long")
    return source.mapInArrow(run, schema)


class Mixture:
    """A mixture of ``sized`` (pinned: row, doc_id, source, tie, size); ``plan`` has the slots, ``pieces`` the blocks' parts."""

    def __init__(self, sized: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 7, weights: tuple = WEIGHTS):
        spark = sized.sparkSession
        found = in_order(sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size")))
        #: (name, source_no, source_size, target)
        self.sources = C.pin(with_targets(found, weights), "targets")
        runs = C.pin(slot_runs(self.sources, block, shards, seed), "runs")
        #: (shard, slot, source_no, pass, block): the mixture, in order.
        self.plan = runs.repartition(C.n_partitions(spark), "shard", "source_no", "lo").mapInArrow(_fill(seed), SLOTS)
        names = F.broadcast(self.sources) if self.sources.count() <= SENT else self.sources.hint("merge")
        named = sized.join(names, sized["source"].eqNullSafe(self.sources["name"])).drop("name")
        self.placed = C.pin(C.prefix_sums(C.pin(named, "named"), "doc_id", {"size": "at"}, group="source_no", ties=["tie", "row"]), "placed")
        blocks = self.placed.where("size > 0").select("row", "source_no", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
        lo, hi = F.greatest(F.col("block") * block, "at") - F.col("at"), F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - F.col("at")
        #: (row, source_no, block, lo, hi): words lo to hi of a document are in the block. Its joins are told to
        #: shuffle, as Spark guesses its size, and that of the slots, from the few rows they are made from.
        self.pieces = blocks.select("row", "source_no", "block", lo.alias("lo"), hi.alias("hi"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of each document."""
        times = self.plan.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        got = self.pieces.hint("merge").join(times, ["source_no", "block"]).groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        out = self.placed.join(got, "row", "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

    def parts(self) -> DataFrame:
        """(row, parts): of each document that is taken, its (pass, lo, hi) in order; as many as its blocks and passes."""
        got = self.pieces.hint("merge").join(self.plan.select("source_no", "block", "pass"), ["source_no", "block"])
        return got.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pass", "lo", "hi"))).alias("parts"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``."""
    return Mixture(C.pin(word_counts(docs, []), "sizes"), **how).taken()


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture as documents with the columns of ``docs``: a row for each document and pass that takes words of it.

    A pass that takes all words keeps the text as it is; else the taken words, joined by one space. ``n_chars``
    follows the text.
    """
    # the rows as one struct: no name in it meets a helper column
    named = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"), F.struct("*").alias("whole"))
    sized = C.pin(word_counts(named, ["whole"]), "docs")
    parts = Mixture(sized.select("row", "doc_id", "source", "tie", "size"), **how).parts()
    rows = sized.select("row", "size", F.col("whole.text").cast("string").alias("text"), "whole").join(parts, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_blocks(batches):
            at, texts = [], []
            for k, (size, text, own) in enumerate(zip(batch.column("size").to_pylist(), C.as_bytes(batch.column("text")), batch.column("parts").to_pylist(), strict=True)):
                by: dict[int, list[tuple[int, int]]] = {}
                for p in own:
                    by.setdefault(p["pass"], []).append((p["lo"], p["hi"]))
                words = text.split()
                for p in sorted(by):
                    whole = sum(b - a for a, b in by[p]) == size
                    at.append(k)
                    texts.append((text if whole else b" ".join(w for a, b in by[p] for w in words[a:b])).decode())
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("whole").take(took)], ["text", "whole"])

    schema = rows.select("text", "whole").schema
    out = rows.mapInArrow(run, schema)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    own = {"text": F.col("text"), **length}
    return out.select(*[own.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
