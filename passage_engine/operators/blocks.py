"""Blocks: pages dealt by collection and range of file names, so that no chunk or posting is dealt again.

A block is a run of a collection's files in order of name, of about ``BLOCK`` bytes of text. Its pages meet in one task, where they are
cut, numbered, counted and weighted; from block to block go document frequencies, a row for each term of a block, and numbers of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.functions import text as T
from passage_engine.operators import chunking
from passage_engine.operators.chunking import Cut
from passage_engine.operators.topk import check_k, top_k
from passage_engine.sources import tables

DIGITS = 6  # scores are rounded before they are ranked, so that the order of a sum doesn't decide a tie
BLOCK = 4 << 20  # bytes of text
NAMES = 30  # names drawn for each block, to place the cuts between blocks
RUNS = 1 << 16  # blocks of a collection at most; beyond, they are larger
SMALL = 1_000_000  # rows that may be sent to all executors
CHUNK = ["block", "p", "nth"]


@dataclass(frozen=True)
class Dealt:
    """``rows`` (block, text, and where the text stands), not dealt yet; ``partitions`` to deal them to; ``place`` numbers rows that were dealt.

    ``placed`` rows have (block, p, nth, at, text): the place in ``pipelines``, the number in the block and pipeline, where to find the text.
    """

    rows: DataFrame
    blocks: DataFrame  # (block, space, run, collection_id), a table
    pipelines: int
    partitions: int
    place: Callable[[DataFrame], DataFrame]

    def meet(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.partitions, "block")

    def placed(self) -> DataFrame:
        return self.place(self.meet(self.rows))


#: While false, joins of tables that are dealt by block may have further keys without dealing them anew.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` for plans that are run later and join by block; ``spark`` stays as it is."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(CO_PARTITION, "false")
    return own


@contextmanager
def by_block(spark: SparkSession) -> Iterator[None]:
    """For what is run while this lasts, the same."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def small(rows: DataFrame) -> DataFrame:
    """A table, marked to be sent to all executors if it is small."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def numbers(spark: SparkSession, blocks: int, partitions: int) -> DataFrame:
    """(i, block): numbers for ``blocks`` blocks, such that ``partitions`` dealt by them get equally many."""
    rounds = -(-blocks // partitions)
    tried = partitions * (2 * rounds + 30)
    slot = F.pmod(F.hash("id"), F.lit(partitions))
    nth = F.row_number().over(Window.partitionBy("slot").orderBy("id")) - 1
    found = spark.range(tried).withColumn("slot", slot).withColumn("nth", nth).where(F.col("nth") < rounds)
    each = spark.range(blocks).select(F.col("id").alias("i")).join(found.select((F.col("nth") * partitions + F.col("slot")).alias("i"), "id"), "i", "left")
    return each.select("i", F.coalesce("id", F.col("i") + tried).alias("block"))


def deal(pages: DataFrame, cuts: tuple[Cut, ...]) -> Dealt:
    """Number the blocks of ``pages``: in order within a collection. Names are drawn to place the cuts only; each file has its block whatever is drawn."""
    spark, whole = pages.sparkSession, pages.select("collection_id", F.coalesce("source_file", "collection_id").alias("source_file"), "page", "text")
    held = tables.pin(whole.groupBy("collection_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")), "collections")
    total = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = held.select("collection_id", "n", F.least(F.ceil(F.col("bytes") / BLOCK), F.lit(RUNS)).cast("int").alias("parts")).where("parts > 1")
    drawn = whole.select("collection_id", "source_file").join(large, "collection_id").where(F.rand(1) < NAMES * F.col("parts") / F.col("n"))
    names = drawn.groupBy("collection_id", "parts").agg(F.sort_array(F.collect_list("source_file")).alias("names"))
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("names", F.floor(i * F.size("names") / F.col("parts")).cast("int")))
    cut_at = names.select(F.col("collection_id").alias("of"), F.array_distinct(at).alias("cuts"))
    spaces = held.join(cut_at, F.col("collection_id") == F.col("of"), "left").select("collection_id", F.coalesce("cuts", F.array().cast("array<string>")).alias("cuts"))
    spaces = tables.pin(spaces.select("*", F.monotonically_increasing_id().alias("space")), "spaces")
    runs = spaces.select("space", "collection_id", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("run"))
    runs = tables.pin(runs.withColumn("i", F.row_number().over(Window.orderBy("space", "run")).cast("long") - 1), "runs")  # a row a block
    n = max(1, runs.count())
    wide = int(min(n, max(spark.sparkContext.defaultParallelism, 2 * total // BLOCK)))
    blocks = tables.pin(runs.join(numbers(spark, n, wide), "i").drop("i"), "blocks")
    own = spaces.select(F.col("collection_id").alias("of"), "cuts", "space")
    run = F.size(F.filter("cuts", lambda c: c <= F.col("source_file"))).alias("run")
    rows = whole.join(own, F.col("collection_id").eqNullSafe(F.col("of"))).select("space", run, "source_file", "page", "text")
    rows = rows.join(small(blocks.drop("collection_id")), ["space", "run"]).select("block", "source_file", "page", "text")
    return Dealt(rows, blocks, len(cuts), wide, lambda dealt: place(dealt, cuts))


def by_page(rows: DataFrame) -> DataFrame:
    """Add ``doc``, the row's place in its block, and ``page_nth``, which rows of the same file and page share."""
    own = Window.partitionBy("block")
    return rows.withColumn("doc", F.row_number().over(own.orderBy("source_file", "page", "text_hash"))).withColumn("page_nth", F.dense_rank().over(own.orderBy("source_file", "page")))


def place(dealt: DataFrame, cuts: tuple[Cut, ...]) -> DataFrame:
    """The chunks of pages that were dealt, each page being read once: in order of file, page, segment and window in their block and pipeline."""
    docs = by_page(dealt.withColumn("text_hash", F.xxhash64("text")))
    each = docs.select("block", "source_file", "page", "doc", "page_nth", F.posexplode(chunking.pieces(F.col("text"), cuts)).alias("piece", "w"))
    held = each.select("block", "w.p", "source_file", "page", "doc", "page_nth", "piece", "w.segment_ord", "w.window_ord", "w.start", "w.end", "w.section_title", "w.text")
    own = Window.partitionBy("block", "p").orderBy("page_nth", "segment_ord", "window_ord", "doc")
    return held.withColumn("nth", F.row_number().over(own) - 1).withColumn("at", F.shiftleft(F.col("doc").cast("long"), 32) + F.col("piece"))


def firsts(sizes: DataFrame, dealt: Dealt) -> DataFrame:
    """(block, space, before, total), a table: for each pipeline the chunks of the blocks before this in its space, and of all. ``sizes``: (block, n) with arrays."""
    held = dealt.blocks.join(sizes, "block", "left")
    n = [F.coalesce(F.get("n", F.lit(i)), F.lit(0)).cast("long") for i in range(dealt.pipelines)]
    whole = Window.partitionBy("space")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.array(*[F.coalesce(F.sum(x).over(w), F.lit(0)) for x in n]) for w in (before, whole)]
    return tables.pin(held.select("block", "space", sums[0].alias("before"), sums[1].alias("total")), "firsts")


def numbered(pages: DataFrame, cuts: tuple[Cut, ...]) -> DataFrame:
    """Chunks of ``pages`` with ``chunk_ord``. Texts of pages are dealt once, those of chunks never."""
    dealt = deal(pages, cuts)
    n = dealt.rows.select("block", *[x.alias(f"n{i}") for i, x in enumerate(chunking.counts(F.col("text"), cuts))])
    first = firsts(n.groupBy("block").agg(F.array(*[F.sum(f"n{i}") for i in range(len(cuts))]).alias("n")), dealt)
    own = named(dealt.placed().join(small(first), "block"), dealt, cuts)
    return own.select("collection_id", "pipeline", (F.get("before", F.col("p")) + F.col("nth")).cast("int").alias("chunk_ord"), "source_file", "page", "start", "end", "section_title", "text")


def named(rows: DataFrame, dealt: Dealt, cuts: tuple[Cut, ...]) -> DataFrame:
    """Add collection_id and pipeline to rows with block and p."""
    pipeline = F.get(F.array(*[F.lit(c.pipeline) for c in cuts]), F.col("p"))
    return rows.withColumn("pipeline", pipeline).join(small(dealt.blocks.select("block", "collection_id")), "block")


# ---------------------------------------------------------------- terms


def idf(df: Column, total: Column) -> Column:
    return F.log((1 + total) / (1 + df)) + 1


@dataclass(frozen=True)
class Index:
    """Term statistics of chunks that are dealt by block.

    ``stats``: (block, term, df, lead), a table with a row for each term of a block, df being those of its space as an array by pipeline;
    one row of a space and term has ``lead``.
    """

    dealt: Dealt
    stats: DataFrame
    first: DataFrame
    stop_words: frozenset[str] | None = None

    def weighted(self) -> DataFrame:
        """(block, p, nth, at, before, term, tf, df, idf, w): a row for each term of a chunk, in order of chunks; to be run ``by_block`` or in such a ``session``."""
        held = self.stats.drop("lead").join(small(self.first.drop("space")), "block").repartition(self.dealt.partitions, "block")
        each = self.dealt.placed().select(*CHUNK, "at", F.explode(T.term_counts(F.col("text"), self.stop_words)).alias("t")).select(*CHUNK, "at", "t.term", "t.tf")
        met = each.join(held.hint("shuffle_hash"), ["block", "term"]).withColumns({x: F.get(x, F.col("p")) for x in ("df", "total", "before")})
        return met.withColumn("idf", idf(F.col("df"), F.col("total"))).withColumn("w", F.col("tf") * F.col("idf")).drop("total")

    def postings(self) -> DataFrame:
        """``weighted`` with ``weight``, that of a unit vector. Rows come in order of chunks, so that the window has nothing to sort."""
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*CHUNK)))
        return self.weighted().withColumn("weight", F.col("w") / norm)

    def term_stats(self) -> DataFrame:
        """(block, p, term, df, idf) with a row for each term of a space and pipeline."""
        each = self.stats.where("lead").join(small(self.first), "block").select("block", "term", F.posexplode(F.arrays_zip("df", "total")).alias("p", "s")).where("s.df > 0")
        return each.select("block", "p", "term", F.col("s.df").alias("df"), idf(F.col("s.df"), F.col("s.total")).alias("idf"))

    def norms(self) -> DataFrame:
        return self.weighted().groupBy(*CHUNK, "before").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def spread_stats(dealt: Dealt, stop_words: frozenset[str] | None = None) -> DataFrame:
    """(block, term, n, df, lead): chunks with the term in the block and in its space, as arrays by pipeline; a term of null stands for all chunks.

    Terms are counted where their block is, and a row for each of a block's terms is dealt.
    """
    all_of = F.array(F.lit(None).cast("string"))
    each = dealt.placed().select("block", "p", F.explode(F.concat(F.array_distinct(T.terms(F.coalesce("text", F.lit("")), stop_words)), all_of)).alias("term"))
    names = [f"n{i}" for i in range(dealt.pipelines)]
    held = each.groupBy("block", "term").agg(*[F.count_if(F.col("p") == i).alias(x) for i, x in enumerate(names)])
    own = Window.partitionBy("space", "term")
    met = held.join(small(dealt.blocks.select("block", "space")), "block").repartition(dealt.partitions, "space", "term")
    return met.select("block", "term", F.array(*names).alias("n"), F.array(*[F.sum(x).over(own) for x in names]).alias("df"), (F.row_number().over(own.orderBy("block")) == 1).alias("lead"))


def index(dealt: Dealt, stop_words: frozenset[str] | None = None) -> Index:
    stats = tables.pin(spread_stats(dealt, stop_words), "terms")
    first = firsts(stats.where("term is null").select("block", "n"), dealt)
    return Index(dealt, stats.where("term is not null").select("block", "term", "df", "lead"), first, stop_words)


def question_terms(own: Index, questions: DataFrame) -> DataFrame:
    """(space, p, term, question_idx, q), a table: unit vectors of the questions in each space and pipeline; terms unknown there don't count."""
    each = questions.select("question_idx", F.explode(T.term_counts(F.col("question"), own.stop_words)).alias("t")).select("question_idx", "t.*")
    asked = tables.pin(each.groupBy("question_idx", "term").agg(F.sum("tf").alias("tf")), "asked")
    known = own.stats.where("lead").join(small(tables.pin(asked.select("term").distinct(), "asked_terms")), "term").join(small(own.first), "block")
    long = known.join(asked, "term").select("space", "term", "question_idx", "tf", F.posexplode(F.arrays_zip("df", "total")).alias("p", "s")).where("s.df > 0")
    raw = long.withColumn("q", F.col("tf") * idf(F.col("s.df"), F.col("s.total")))
    norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("space", "question_idx", "p")))
    return tables.pin(raw.select("space", "p", "term", "question_idx", (F.col("q") / norm).alias("q")), "question_terms")


def search(own: Index, questions: DataFrame, k: int) -> DataFrame:
    """(question_idx, space, p, rank, score, chunk_ord, block, at): the k best chunks of each question in each space and pipeline.

    Chunks are scored where their block is, and k rows a question, block and pipeline are dealt again. Chunks without a common term score 0
    and fill up: as ties go by chunk_ord, only the first k of a space can be among them, so k padding rows a question stand for all.
    """
    check_k(k)
    spark, dealt = questions.sparkSession, own.dealt
    asked = question_terms(own, questions)
    met = own.postings().join(small(own.first.select("block", "space")), "block").join(small(asked), ["space", "p", "term"])
    dots = met.groupBy(*CHUNK, "at", "question_idx").agg(F.round(F.sum(F.col("weight") * F.col("q")), DIGITS).alias("score"))
    best = top_k(dots, ["block", "p", "question_idx"], k, [F.desc("score"), F.asc("nth")])
    with by_block(spark):
        hits = tables.pin(best.drop("rank"), "hits")
    early = own.first.where(F.exists("before", lambda x: x < k)).select("block")
    padding = tables.pin(dealt.place(dealt.meet(dealt.rows.join(small(early), "block", "left_semi"))).where(F.col("nth") < k).select(*CHUNK, "at"), "padding")
    rows = hits.unionByName(padding.crossJoin(questions.select("question_idx")).withColumn("score", F.lit(0.0))).join(small(own.first.drop("total")), "block")
    rows = rows.withColumn("chunk_ord", (F.get("before", F.col("p")) + F.col("nth")).cast("int"))
    merged = rows.groupBy("question_idx", "space", "p", "chunk_ord", "block", "at").agg(F.max("score").alias("score"))
    return top_k(merged, ["question_idx", "space", "p"], k)


def retrieve(pages: DataFrame, cuts: tuple[Cut, ...], questions: DataFrame, k: int, stop_words: frozenset[str] | None = None) -> DataFrame:
    """(question_idx, collection_id, pipeline, rank, score, chunk_ord) over the chunks of ``pages``."""
    dealt = deal(pages, cuts)
    return named(search(index(dealt, stop_words), questions, k), dealt, cuts).select("question_idx", "collection_id", "pipeline", "rank", "score", "chunk_ord")


def retrieve_passages(pages: DataFrame, cuts: tuple[Cut, ...], questions: DataFrame, k: int, stop_words: frozenset[str] | None = None) -> DataFrame:
    """``retrieve`` with text and meta. Only the pages of the k best chunks are cut again."""
    dealt = deal(pages, cuts)
    found = tables.pin(named(search(index(dealt, stop_words), questions, k), dealt, cuts).withColumn("doc", F.shiftrightunsigned("at", 32).cast("int")), "found")
    hashed = dealt.rows.withColumn("text_hash", F.xxhash64("text"))
    docs = small(tables.pin(found.select("block", "doc").distinct(), "found_docs"))
    wanted = tables.pin(by_page(dealt.meet(hashed.drop("text"))).join(docs, ["block", "doc"]).select("block", "doc", "source_file", "page", "text_hash"), "wanted")
    own = small(wanted.withColumnsRenamed({x: f"_{x}" for x in ("block", "source_file", "page", "text_hash")}))
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in ("source_file", "page")]
    texts = hashed.join(own, [F.col("block") == F.col("_block"), F.col("text_hash") == F.col("_text_hash"), *same]).select("block", "doc", "source_file", "page", "text")
    meta = F.struct(F.col("collection_id").alias("doc_id"), "page", "w.start", "w.end", "w.section_title", "source_file").alias("meta")
    cut = texts.select("block", "doc", "source_file", "page", F.posexplode(chunking.pieces(F.col("text"), cuts)).alias("piece", "w"))
    keyed = found.withColumn("piece", F.col("at").bitwiseAND((1 << 32) - 1).cast("int"))
    met = cut.join(small(keyed), ["block", "doc", "piece"])
    once = ["question_idx", "collection_id", "pipeline", "rank"]  # equal rows of pages find each other's chunks
    return met.select(*once, "score", "chunk_ord", "w.text", meta).dropDuplicates(once)
