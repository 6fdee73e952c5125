"""Passages: one window operator over the tokens of pages or of heading segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.config import DEFAULTS, Defaults
from passage_engine.functions import text as T
from passage_engine.sources import tables

ORDER = ["source_file", "page", "segment_ord", "window_ord"]


def window_count(n: Column, size: int, step: int) -> Column:
    """Windows over ``n`` tokens: the last is the first to reach the end; with gaps, none starts beyond it."""
    reach = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)) + 1
    return F.when(n > 0, F.least(reach, F.ceil(n / F.lit(step)))).otherwise(0).cast("int")


def windows(parts: Column, size: int, step: int) -> Column:
    """(start, end, text) of each window, cut inside the row: the token array is never copied to the rows it gives."""
    n = F.size(parts)
    numbers = F.when(n > 0, F.sequence(F.lit(0), window_count(n, size, step) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.struct((k * step).alias("start"), F.least(k * step + size, n).cast("int").alias("end"), T.join_tokens(F.slice(parts, k * step + 1, size)).alias("text")))


def check(size: int, step: int) -> None:
    if size <= 0 or step <= 0:
        raise ValueError("a window needs a positive size and must move forward")


def _cut(rows: DataFrame, pipeline: str, size: int, step: int) -> DataFrame:
    """Windows of rows (collection_id, source_file, page, segment_ord, section_title, body)."""
    check(size, step)
    keep = ["collection_id", "source_file", "page", "segment_ord", "section_title"]
    held = rows.select(*keep, T.tokens(F.col("body")).alias("tokens"))
    cut = held.select(*keep, F.posexplode(windows(F.col("tokens"), size, step)).alias("window_ord", "w"))
    return cut.select("collection_id", F.lit(pipeline).alias("pipeline"), "source_file", "page", "segment_ord", "window_ord", "w.start", "w.end", "section_title", "w.text")


def _whole(pages: DataFrame) -> DataFrame:
    return pages.select("collection_id", F.coalesce("source_file", "collection_id").alias("source_file"), "page", F.lit(0).alias("segment_ord"), F.lit(None).cast("string").alias("section_title"), F.col("text").alias("body"))


def fixed(pages: DataFrame, size: int = DEFAULTS.fixed_size, overlap: int = DEFAULTS.fixed_overlap, pipeline: str = "fixed") -> DataFrame:
    if overlap < 0:
        raise ValueError("an overlap can't be negative")
    return _cut(_whole(pages), pipeline, size, size - overlap)


def sliding(pages: DataFrame, window: int = DEFAULTS.window, stride: int = DEFAULTS.stride) -> DataFrame:
    return _cut(_whole(pages), "sliding", window, stride)


def structure(pages: DataFrame, size: int = DEFAULTS.fixed_size, overlap: int = DEFAULTS.fixed_overlap) -> DataFrame:
    """Fixed windows inside the segments between headings."""
    if overlap < 0:
        raise ValueError("an overlap can't be negative")
    whole = _whole(pages)
    parts = whole.select("collection_id", "source_file", "page", F.posexplode(T.segments(F.col("body"))).alias("segment_ord", "s"))
    return _cut(parts.select("collection_id", "source_file", "page", "segment_ord", F.col("s.title").alias("section_title"), F.col("s.body").alias("body")), "structure", size, size - overlap)


def semantic(pages: DataFrame, size: int = DEFAULTS.fixed_size, overlap: int = DEFAULTS.fixed_overlap, pipeline: str = "semantic") -> DataFrame:
    """Fixed windows, to be indexed by vectors."""
    return fixed(pages, size, overlap, pipeline)


def ground_truth_windows(pages: DataFrame, size: int = DEFAULTS.truth_size, overlap: int = DEFAULTS.truth_overlap) -> DataFrame:
    return fixed(pages, size, overlap, "ground_truth")


def all_classic(pages: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    return fixed(pages, d.fixed_size, d.fixed_overlap).unionByName(structure(pages, d.fixed_size, d.fixed_overlap)).unionByName(sliding(pages, d.window, d.stride))


@dataclass(frozen=True)
class Cut:
    """Windows of a pipeline: over whole pages, or inside the segments between headings."""

    pipeline: str
    size: int
    step: int
    by_heading: bool = False


def classic(d: Defaults = DEFAULTS) -> tuple[Cut, ...]:
    return Cut("fixed", d.fixed_size, d.fixed_size - d.fixed_overlap), Cut("structure", d.fixed_size, d.fixed_size - d.fixed_overlap, True), Cut("sliding", d.window, d.stride)


def pieces(body: Column, cuts: tuple[Cut, ...]) -> Column:
    """Array of the chunks of one page, of all ``cuts``: (p, the place in ``cuts``, segment_ord, window_ord, start, end, section_title, text)."""
    none = F.lit(None).cast("string")

    def of(c: Cut, parts: Column, segment: Column, title: Column) -> Column:
        check(c.size, c.step)
        return F.transform(windows(parts, c.size, c.step), lambda w, k: F.struct(F.lit(cuts.index(c)).alias("p"), segment.alias("segment_ord"), k.alias("window_ord"), w["start"].alias("start"), w["end"].alias("end"), title.alias("section_title"), w["text"].alias("text")))

    def inside(c: Cut) -> Column:
        return F.flatten(F.transform(T.segments(body), lambda s, j: T.let(T.tokens(s["body"]), lambda parts: of(c, parts, j, s["title"]))))

    whole, headed = [c for c in cuts if not c.by_heading], [c for c in cuts if c.by_heading]
    out = [T.let(T.tokens(body), lambda parts: F.concat(*[of(c, parts, F.lit(0), none) for c in whole]))] if whole else []
    return F.concat(*out, *map(inside, headed))


def counts(body: Column, cuts: tuple[Cut, ...]) -> list[Column]:
    """Number of chunks of one page, for each of ``cuts`` in order; no text is joined."""
    n = F.size(T.tokens(body))

    def of(c: Cut) -> Column:
        check(c.size, c.step)
        if not c.by_heading:
            return T.let(n, lambda x: window_count(x, c.size, c.step))
        each = F.transform(T.segments(body), lambda s: T.let(F.size(T.tokens(s["body"])), lambda x: window_count(x, c.size, c.step)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    return [F.coalesce(of(c), F.lit(0)) for c in cuts]


RUNS = 64


def _range_of(files: DataFrame, name: str) -> Column:
    """Number of the range of names that ``name`` lies in: ``RUNS`` ranges of about as many names each, cut by a sample of names.

    The sample only places the cuts; every name has its range whatever the sample holds.
    """
    n = files.count()
    if n <= RUNS * RUNS:
        return F.lit(0)
    share = min(1.0, 20 * RUNS / n)
    seen = sorted({r[0] for r in files.select(name).sample(share, 1).collect() if r[0] is not None}, key=lambda x: x.encode())  # about 20 * RUNS names
    cuts = seen[len(seen) // RUNS :: max(1, len(seen) // RUNS)]
    return sum((F.coalesce(F.col(name) >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunk_ord``: place of a chunk in its collection and pipeline, in order of ``ORDER``.

    Chunks are read twice, the first time for the files' counts, which are written; a caller with a large corpus hands
    in written chunks, so that nothing is cut twice and counts read no texts. A collection's chunks never meet in one
    task: chunks are numbered within their file, files within ``RUNS`` ranges of names, ranges within the collection.
    """
    own = ["collection_id", "pipeline"]
    counted = tables.pin(chunks.groupBy(*own, "source_file").agg(F.count("*").alias("n")), "files")
    run = _range_of(counted, "source_file")
    files = counted.withColumn("run", run)
    runs = files.groupBy(*own, "run").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*own).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*own, "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*own, "run").orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(runs, [*own, "run"])
    files = files.select(*own, "source_file", (F.col("first") + F.col("before")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy(*own, "source_file").orderBy("page", "segment_ord", "window_ord"))
    placed = chunks.withColumn("nth", nth).join(files, [*own, "source_file"])
    return placed.select(*own, (F.col("offset") + F.col("nth") - 1).cast("int").alias("chunk_ord"), "source_file", "page", "start", "end", "section_title", "text")
