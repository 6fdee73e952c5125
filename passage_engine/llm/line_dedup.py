"""Fuzzy line dedup by MinHash.

1. A line (texts are cut at newlines) becomes its set of character shingles: all runs of ``CHARS`` characters, at every
   place of the line; a shorter line is one shingle. A shingle's hash puts it into one of ``BANDS * ROWS`` bins, and the
   least hash of each bin is the line's MinHash signature by one permutation, in ``BANDS`` bands. Empty bins of a band
   take the value of the first other bin, in an order of the band's own, that has one.
2. Equal lines collapse by a 128-bit hash; equal bands put lines into a bucket, with star-shaped candidates.
3. Odd sketches (``similarity``) rule pairs out exactly before texts move; the rest are verified by the exact Jaccard
   similarity of their full sets (``PERCENT``), as 64-bit hashes of the shingles.
4. Of buckets whose other members aren't one component yet, those outside the largest one face all others, as far as
   sketches allow a link, in ``SHARES`` of growing size: whoever is linked by an early share isn't compared again. No link
   within a bucket is lost. Sketches of a bucket's members are compared in number as the square of its size; only pairs
   that they leave become rows.
5. Distributed union-find gives components; of each, the occurrence with the least (doc_id, line number) is kept.

Of large sets, a pair of similarity 0.8 shares no band with a probability of (1 - 0.8**3)**10 < 0.001, as with
permutations of their own; for small sets the test measures it. Everything is a DataFrame function.
Lines without a word are always kept and belong to no component. Null texts have no lines. Null doc_ids come
first; equal rows are occurrences of the same line, so the first is kept (of equal (doc_id, line number), all).
Other columns are not read.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.llm import common as C
from passage_engine.llm import similarity

CHARS, BANDS, ROWS, PERCENT = 8, 10, 3, 80
SPACE = r"\x20\x09-\x0D"
#: Bins of which a band asks each for a value for its empty ones, before all in one order.
REACH, SEED = 10, 5
#: Words of an odd sketch.
SKETCH = 16
#: Where the shares of an open bucket end that its smaller components face one after the other.
SHARES = (0, 1, 4, 16)
#: Bits that tell wanted lines from others, for each wanted one and in all (16 MB).
SIFT, MOST_BITS = 16, 1 << 27


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines with a word."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return cut.where(F.col("line").rlike(f"[^{SPACE}]"))


def shingle_places(line: Column, chars: int = CHARS) -> Column:
    """Where each shingle starts in the ``points`` of a line: one place for each run of ``chars`` characters, or for a shorter line."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), 4 * F.length(line) - 4 * chars + 1), F.lit(4))


def points(line: Column) -> Column:
    """The characters of a line in four bytes each, so that a shingle is cut out without counting from the start."""
    return F.encode(line, "UTF-32")


def shingle_hash(coded: Column, place: Column, chars: int = CHARS) -> Column:
    return F.xxhash64(F.substring(coded, place, F.lit(4 * chars)))


def shingle_hashes(line: Column, chars: int = CHARS) -> Column:
    """Hashes of the shingles of a line in order, repeats included."""
    each = lambda coded: F.transform(shingle_places(line, chars), lambda place: shingle_hash(coded, place, chars))
    return F.transform(F.array(points(line)), each)[0]  # a variable of a lambda isn't copied for each shingle, as a column is


def signed(own: DataFrame, keys: list[str], chars: int, bands: int, rows: int) -> DataFrame:
    """``keys`` of the lines of ``own``, their least ``place``, and the bands b0, b1, ... of their MinHash signature."""
    bins = bands * rows
    each = own.withColumn("points", points(F.col("line"))).withColumn("at", F.explode(shingle_places(F.col("line"), chars)))
    each = each.withColumn("h", shingle_hash(F.col("points"), F.col("at"), chars))
    each = each.withColumn("bin", F.shiftright(F.col("h").bitwiseAND(0xFFFFFFFF) * bins, 32).cast("int"))
    # FILTER skips what is of another bin, which costs far less than a value of null for it
    least = [F.expr(f"min(cast(shiftright(h, 32) as int)) FILTER (WHERE bin = {k})").alias(f"m{k}") for k in range(bins)]
    out = each.groupBy(*keys).agg(F.expr("min(place) FILTER (WHERE at = 1)").alias("place"), *least)
    # the empty bins of a band take the value of the first other bin, in an order of the band's own, that has one
    rng = random.Random(SEED)
    order = [rng.sample(range(bins), bins) for _ in range(bands)]
    out = out.withColumn("some", F.coalesce(*[f"m{j}" for j in order[0]]))
    out = out.select("*", *[F.coalesce(*[f"m{j}" for j in own[:REACH]], "some").alias(f"fill{k}") for k, own in enumerate(order)])
    at = lambda k: [F.coalesce(f"m{j}", f"fill{k}") for j in range(k * rows, (k + 1) * rows)]
    return out.select(*keys, "place", *[F.xxhash64(F.lit(k), *at(k)).alias(f"b{k}") for k in range(bands)])


@contextmanager
def unfused(spark: SparkSession, fields: int) -> Iterator[None]:
    """Operators with more than ``fields`` columns aren't fused with others: their methods would be too long to be compiled."""
    key = "spark.sql.codegen.maxFields"
    before = spark.conf.get(key)
    spark.conf.set(key, str(fields))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sketches(texts: DataFrame, chars: int) -> DataFrame:
    """(id, n, s0, s1, ...) of texts (id, text), one for an id: sizes and odd sketches of their sets (see ``similarity``)."""
    h = texts.select("id", F.explode(F.array_distinct(shingle_hashes(F.col("text"), chars))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    h = h.select("id", bit, F.expr(f"cast(shiftright(h, 6) & {SKETCH - 1} as int)").alias("word"))
    words = [F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {k}), 0L)").alias(f"s{k}") for k in range(SKETCH)]
    return h.groupBy("id").agg(F.count("*").alias("n"), *words)


def sketch(name: str) -> Column:
    return F.struct("n", *[f"s{k}" for k in range(SKETCH)]).alias(name)


def near(a: str, b: str, percent: int) -> Column:
    """Whether the sets whose sizes and sketches are in the structs ``a`` and ``b`` can be alike: false only if they aren't."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(add, [F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH)])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def not_far(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that sizes and sketches don't rule out."""
    x, y = sets.select(F.col("id").alias("a"), sketch("x")), sets.select(F.col("id").alias("b"), sketch("y"))
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").where(near("x", "y", percent)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, percent: int, chars: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are alike, by the exact Jaccard similarity."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")).join(sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")), x)
    met = pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a")
    both = F.size(F.array_intersect(shingle_hashes(F.col("text_a"), chars), shingle_hashes(F.col("text_b"), chars)))
    return met.where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def linked(member: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, chars: int) -> DataFrame:
    """Components (node, root) of the links within the buckets ``member`` (key, id); ``texts_of`` gives (id, text) of ids (id)."""
    own = Window.partitionBy("key")
    multi = member.select("key", "id", F.min("id").over(own).alias("hub"), F.max("id").over(own).alias("most")).where("hub < most")
    multi = C.pin(multi.select("key", "id", "hub"), "buckets")
    texts = C.pin(texts_of(multi.select("id").distinct()), "texts")
    if texts.count() > texts.select("id").distinct().count():  # equal rows of ``docs``
        texts = C.pin(texts.dropDuplicates(["id"]), "texts")
    sets = C.pin(sketches(texts, chars), "sketches")

    def links_of(pairs: DataFrame) -> DataFrame:
        return C.pin(confirmed(pairs, texts, sets, percent, chars), "links")

    hubs = multi.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    labels = C.components(links_of(C.pin(not_far(hubs, sets, percent), "told")))
    rooted = lambda rows: rows.join(labels, F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))
    own = C.pin(rooted(multi.where("hub <> id").select("key", "id")), "rooted")
    sides = similarity.minorities(own).where("outside > 0").select("key", "most")
    own = C.pin(own.join(sides, "key").hint("merge").join(sets.select("id", sketch("x")), "id"), "open")
    others = lambda rows: rows.select(F.col("key").alias("in"), F.col("id").alias("to"), F.col("root").alias("top"), F.col("x").alias("y"))
    met = (F.col("key") == F.col("in")) & (F.col("root") != F.col("top")) & near("x", "y", percent)
    some = C.pin(own.where("root <> most").hint("merge").join(others(own), met, "left_semi").select("key", "id"), "some")
    busy = C.pin(own.join(some.select("key").distinct(), "key").drop("root"), "busy")
    dealt = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(SHARES[-1]))
    once = (F.col("top") == F.col("first")) | (F.col("id") < F.col("to"))  # of two members outside, one faces the other
    for low, high in itertools.pairwise(SHARES):
        now = C.pin(rooted(busy), "now")
        mine = now.join(some, ["key", "id"], "left_semi")
        # the largest component may have another root by now
        tops = now.select("most").distinct().join(labels, F.col("most") == F.col("node"), "left").select("most", F.coalesce("root", "most").alias("first"))
        part = others(now.where((dealt >= low) & (dealt < high)))
        pairs = mine.join(tops, "most").hint("merge").join(part, met).where(once).select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
        links = links_of(C.pin(pairs, "pairs"))
        if not links.isEmpty():
            labels = similarity.merged(labels, links)
    return labels


def sifted(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """``own`` without most rows whose ``ha`` isn't in ``wanted``, before any of them moves; others stay, so a join must follow.

    ``SIFT`` bits for each row of ``wanted``, ``MOST_BITS`` at most, are broadcast as bitmaps of 4 KB.
    """
    bits = min(MOST_BITS, max(1 << 20, 1 << (SIFT * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.lit(17), "ha"), F.lit(bits))
    maps = wanted.select(F.shiftright(place, 15).alias("map"), place.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = own.select("*", F.shiftright(place, 15).alias("map"), place.bitwiseAND((1 << 15) - 1).cast("int").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    on = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.col("bit").bitwiseAND(7))), F.lit(2)) == 1
    found = placed.join(F.broadcast(maps), "map").where(on)
    return found.select(*own.columns)


def line_components(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, chars: int = CHARS) -> DataFrame:
    """(doc_id, line_no, rep_doc_id, rep_line_no, kept) of every line with a word; the rep is the component's kept line."""
    own = lines(docs).select("doc_id", "line_no", F.xxhash64("line").alias("ha"), F.xxhash64(F.lit(11), "line").alias("hb"), "line")
    # (doc_id, line_no) as one number, which a hash aggregate can keep: null doc_ids below all others
    place = F.coalesce(F.col("doc_id").cast("decimal(30,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(30,0)")) * F.lit(1 << 32).cast("decimal(30,0)") + F.col("line_no")
    nodes = signed(own.withColumn("place", place.cast("decimal(38,0)")), ["ha", "hb"], chars, bands, rows)
    doc = F.floor(F.col("place") / F.lit(1 << 32).cast("decimal(11,0)"))
    line = (F.col("place") - doc.cast("decimal(25,0)") * F.lit(1 << 32).cast("decimal(11,0)")).cast("int")
    first = F.struct(F.when(doc >= F.lit(str(-(1 << 63))).cast("decimal(25,0)"), doc).cast("long").alias("doc_id"), line.alias("line_no")).alias("first")
    nodes = nodes.select("ha", "hb", first, *[f"b{k}" for k in range(bands)])
    with unfused(docs.sparkSession, bands * rows + 3):
        nodes = C.pin(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    member = nodes.select("id", F.explode(F.array(*[f"b{k}" for k in range(bands)])).alias("key")).select("key", "id")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = C.pin(nodes.join(ids, "id", "left_semi").select("id", "ha", "hb", F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("n")), "wanted")
        some = sifted(own, wanted)
        on = some["doc_id"].eqNullSafe(wanted["d"]) & (some["line_no"] == wanted["n"]) & (some["ha"] == wanted["ha"]) & (some["hb"] == wanted["hb"])
        return some.join(wanted, on).select("id", F.col("line").alias("text"))

    labels = linked(member, texts_of, percent, chars)
    # of each line: its own first occurrence, or that of its component
    plain = nodes.select("ha", "hb", "id", "first").join(labels, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    several = labels.select("root").distinct()
    least = C.pin(plain.join(several, "root", "left_semi").groupBy("root").agg(F.min("first").alias("rep")), "reps")
    classes = C.pin(plain.join(least, "root", "left").select("ha", "hb", F.coalesce("rep", "first").alias("rep")), "classes")
    out = own.select("doc_id", "line_no", "ha", "hb").join(classes, ["ha", "hb"])
    out = out.select("doc_id", "line_no", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.line_no").alias("rep_line_no"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("rep_doc_id")) & (F.col("line_no") == F.col("rep_line_no")))


def remove_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the lines that aren't kept; other columns as they are. Rows sharing a doc_id lose the same line numbers."""
    own, gone = C.fresh(docs.columns, "own_id", "gone")
    lost = line_components(docs, **how).where("not kept").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(C.pin(lost, "gone"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(gone, k)), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
