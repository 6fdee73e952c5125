"""Components of similar sets that meet in buckets, with as many candidate pairs as members.

``components`` gets the members of buckets (key, id) and the texts of ids, and finds links within buckets in three steps:

1. *Star*: a bucket's least id is compared with its other members.
2. *Prefixes*: members of buckets that are still in several components are mostly unlike, met by chance or by a common
   passage. An exact filter tells who could be linked at all: two sets with a Jaccard similarity of ``percent`` share
   one of their first ``n - ceil(percent * n / 100) + 1`` members in any order that is the same for all sets. The order
   is by how often open sets hold a member, as counted in ``CELLS`` hashed cells, so common passages come last. Sets
   that share such a member make a finer bucket. In each of ``ROUNDS`` rounds every finer bucket takes another hub, the
   least by a salted hash, with which its members in other components are compared; a member meets as many hubs as it
   has prefix members, so groups whose members aren't all like one of them grow together.
3. *Rest*: of each bucket, those of the members with an open finer bucket that are outside its largest component face
   all of them, in chunks of ``CHUNK`` against parts of ``PART``, with exact intersections counted inside a worker, which
   sends one link for each two components it joins. Only sets near the threshold come here: whether one of them is
   linked can't be told without these comparisons, but no pair becomes a row.

So no link within a bucket is lost. All comparisons are of full sets, as 64-bit
hashes of the shingles.

With ``sketched``, each set also gets an *odd sketch*: ``64 * SKETCH`` parities of its members by a hash. Two sketches differ
in at most as many places as the sets have members that aren't common, so ``near`` rules pairs out exactly and before any
text moves. Then open buckets with up to ``FEW`` members outside their largest component are settled by all pairs of these
with the rest of the bucket, most of which the sketches rule out, and only the others go through steps 2 and 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.llm import common as C

ROUNDS = 3
CELLS = 1 << 16
CHUNK, PART = 512, 2_048
SKETCH, FEW = 8, 64

#: Gives the sorted distinct shingle hashes of each text of a string column.
Shingler = Callable[[pa.Array], list[np.ndarray]]


def alike(mine: np.ndarray, own: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` or more; two empty sets have none."""
    small, large = (mine, own) if len(mine) < len(own) else (own, mine)
    if 100 * len(small) < percent * len(large) or not len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def overlap(shingler: Callable[[], Shingler], percent: int):
    """Keeps the pairs that are alike; of each side, the set of a text that a block has several times is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingler()
        for batch in C.text_blocks(batches, "text_b"):
            for part in C.text_blocks(iter([batch]), "text_a"):
                sides = []
                for name in ("text_a", "text_b"):
                    coded = part.column(name).dictionary_encode()
                    own = sets(coded.dictionary)
                    sides.append([own[k] for k in coded.indices.to_pylist()])
                ok = [alike(x, y, percent) for x, y in zip(*sides, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingler: Callable[[], Shingler], percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked; ``texts``: (id, text) for all ids in them."""
    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.hint("merge").join(b, "b").hint("merge").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(overlap(shingler, percent), "a long, b long")


def _cells(h: np.ndarray) -> np.ndarray:
    return (C.mix(h ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(CELLS)).astype(np.int64)


def _counted(shingler: Callable[[], Shingler]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total = shingler(), np.zeros(CELLS, np.int64)
        for batch in C.text_blocks(batches):
            for own in sets(batch.column("text")):
                total += np.bincount(_cells(own), minlength=CELLS) if len(own) > CELLS // 8 else 0
                if len(own) <= CELLS // 8:
                    np.add.at(total, _cells(own), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def _prefixes(shingler: Callable[[], Shingler], percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingler()
        for batch in C.text_blocks(batches):
            found, sizes, places = [], [], []
            for own in sets(batch.column("text")):
                n = len(own)
                order = np.lexsort((own, counts.value[_cells(own)]))
                found.append(own[order[: n - -(-percent * n // 100) + 1]])
                sizes.append(n)
                places.append(np.arange(len(found[-1])))
            each = np.array([len(x) for x in found], np.int64)
            rows = pa.array(np.repeat(np.arange(len(found)), each))
            sizes = pa.array(np.repeat(np.array(sizes, np.int64), each))
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(np.concatenate([*found, np.empty(0, np.uint64)]))), batch.column("id").take(rows), sizes, pa.array(np.concatenate([*places, np.empty(0, np.int64)]))], ["h", "id", "n", "p"])

    return run


def prefixes(still: DataFrame, texts: DataFrame, shingler: Callable[[], Shingler], percent: int) -> DataFrame:
    """Finer buckets (h, id, n, p) of open members (id), their sizes and the place of h in them; only those that several share."""
    spark = still.sparkSession
    own = C.pin(still.hint("merge").join(texts, "id").select("id", "text"), "still")
    counts = np.zeros(CELLS, np.int64)
    for cell, n in own.select("text").mapInArrow(_counted(shingler), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # CELLS rows at most
        counts[cell] = n
    sent = spark.sparkContext.broadcast(counts)
    first = C.pin(own.mapInArrow(_prefixes(shingler, percent, sent), "h long, id long, n long, p long"), "prefixes")
    sent.unpersist()
    return first.join(first.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h"), "h")


def possible(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that share the member at places p and q can be alike.

    They share at most what lies before the nearer place, the member and what follows the farther one; and of two alike
    sets the smaller has a shared member so early that what follows is still enough for a set of its own size.
    """
    both = F.least(p, q) + 1 + F.least(n - p, m - q) - 1
    early = lambda n, p: (100 + percent) * (n - p) >= 2 * percent * n
    return ((100 + percent) * both >= percent * (n + m)) & F.when(n < m, early(n, p)).when(n > m, early(m, q)).otherwise(early(n, p) & early(m, q))


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[set, word]: parities of the members of each set in ``64 * SKETCH`` hashed cells, as bits."""
    bits, out = 64 * SKETCH, [np.empty((0, SKETCH), np.uint64)]
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        cell = (C.mix(np.concatenate([*part, np.empty(0, np.uint64)]) ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(row * bits + cell, minlength=len(part) * bits) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, SKETCH))
    return np.concatenate(out)


def _sketcher(shingler: Callable[[], Shingler]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler()
        for batch in C.text_blocks(batches):
            sets = make(batch.column("text"))
            words = odd_sketches(sets)
            cells = [pa.array(C.signed(words[:, k])) for k in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([len(x) for x in sets], pa.int64()), *cells], ["id", "text", "n", *(f"s{k}" for k in range(SKETCH))])

    return run


def near(a: str, b: str, percent: int) -> Column:
    """Whether the sets whose sizes and sketches are in the structs ``a`` and ``b`` can be alike: false only if they aren't."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def sketch(name: str) -> Column:
    return F.struct("n", *[f"s{k}" for k in range(SKETCH)]).alias(name)


def not_far(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that sizes and sketches don't rule out."""
    x, y = texts.select(F.col("id").alias("a"), sketch("x")), texts.select(F.col("id").alias("b"), sketch("y"))
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").where(near("x", "y", percent)).select("a", "b").distinct()


def minorities(rows: DataFrame) -> DataFrame:
    """(key, most, outside) of buckets (key, id, root): the largest component, and how many members are outside it."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    return most.select("key", F.col("m.root").alias("most"), (F.col("all") - F.col("m.n")).alias("outside"))


def pairs_of_few(rows: DataFrame, few: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be alike of members outside the largest component with all in others; ``few``: (key, most)."""
    own = C.pin(rows.join(few, "key").hint("merge").join(texts.select("id", sketch("x")), "id"), "few")
    other = own.select("key", F.col("id").alias("to"), F.col("root").alias("top"), F.col("x").alias("y"))
    both = own.where("root <> most").hint("merge").join(other, "key").where((F.col("root") != F.col("top")) & near("x", "y", percent))
    return both.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


class Face:
    """Sets of one chunk, laid out so that a set's intersections with all of them are one gather and one sum."""

    TABLE = 1 << 24

    def __init__(self, percent: int):
        self.percent, self.sets, self.tables, self.top = percent, [], None, {}

    def add(self, own: np.ndarray, root: int) -> None:
        self.sets.append((own, root))

    def _build(self) -> None:
        self.tables, at = [], 0
        while at < len(self.sets):
            to, total = at + 1, len(self.sets[at][0])
            while to < len(self.sets) and (to + 1 - at) * (total + len(self.sets[to][0])) <= self.TABLE:
                total += len(self.sets[to][0])
                to += 1
            part = self.sets[at:to]
            vocabulary = np.unique(np.concatenate([x for x, _ in part]))
            table = np.zeros((len(vocabulary), len(part)), np.uint8)
            for k, (x, _) in enumerate(part):
                table[np.searchsorted(vocabulary, x), k] = 1
            self.tables.append((vocabulary, table, np.array([len(x) for x, _ in part]), [r for _, r in part]))
            at = to

    def _root(self, r: int) -> int:
        while (up := self.top.get(r, r)) != r:
            r = up
        return r

    def links(self, own: np.ndarray, root: int) -> list[tuple[int, int]]:
        """Links from this set's component to others of the chunk that weren't joined with it yet."""
        if self.tables is None:
            self._build()
        out = []
        for vocabulary, table, sizes, roots in self.tables:
            if not len(vocabulary):
                continue
            at = np.searchsorted(vocabulary, own)
            at[at == len(vocabulary)] = 0
            both = table[at[vocabulary[at] == own]].sum(0, dtype=np.int64)
            for k in np.flatnonzero((both > 0) & (100 * both >= self.percent * (sizes + len(own) - both))):
                a, b = self._root(roots[k]), self._root(root)
                if a != b:
                    self.top[max(a, b)] = min(a, b)
                    out.append((a, b))
        return out


def _crosser(shingler: Callable[[], Shingler], percent: int):
    """Links between components within (key, chunk, part); rows come sorted by them and by side: first the chunk, then the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, now, face = shingler(), None, None
        for batch in C.text_blocks(batches):
            found = []
            names = ("key", "chunk", "part", "side", "root")
            for own, (*group, side, root) in zip(sets(batch.column("text")), zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
                if group != now:
                    now, face = group, Face(percent)
                if side == 0:
                    face.add(own, root)
                else:
                    found += face.links(own, root)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def rest(members: DataFrame, texts: DataFrame, shingler: Callable[[], Shingler], percent: int) -> DataFrame:
    """Links (a, b) that join the components of ``members`` (key, id, root) linked within a bucket."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    chunks, parts = F.ceil((F.col("all") - F.col("m.n")) / CHUNK).cast("int"), F.ceil(F.col("all") / PART).cast("int")
    most = C.pin(most.where(F.col("all") > F.col("m.n")).select("key", F.col("m.root").alias("most"), chunks.alias("chunks"), parts.alias("parts")), "most")
    sized = members.join(most, "key")
    of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sized.where("root <> most").select("key", of(1, "chunks").alias("chunk"), every("parts").alias("part"), F.lit(0).alias("side"), "root", "id")
    all_ = sized.select("key", every("chunks").alias("chunk"), of(2, "parts").alias("part"), F.lit(1).alias("side"), "root", "id")
    rows = own.unionByName(all_).hint("merge").join(texts, "id").select("key", "chunk", "part", "side", "root", "text")
    return rows.repartition("key", "chunk", "part").sortWithinPartitions("key", "chunk", "part", "side").mapInArrow(_crosser(shingler, percent), "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) once ``links`` (a, b) between nodes join their components."""
    up = labels.select(F.col("node").alias("a"), F.col("root").alias("x")), labels.select(F.col("node").alias("b"), F.col("root").alias("y"))
    edges = links.join(up[0], "a", "left").join(up[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    more = C.components(edges)
    moved = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return C.pin(moved.unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")


def components(member: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingler: Callable[[], Shingler], percent: int, sketched: bool = False) -> DataFrame:
    """Components of the links within buckets, (node, root) as ``common.components`` gives them.

    ``member`` has the distinct (key, id) of all buckets; ``texts_of`` gives (id, text) for ids (id), read once;
    an id may have several texts and is linked if one of them is. ``sketched``: rule pairs out by sketches first.
    """
    if sketched:  # one sort instead of an aggregate and a join
        own = Window.partitionBy("key")
        multi = member.select("key", "id", F.min("id").over(own).alias("hub"), F.max("id").over(own).alias("most")).where("hub < most")
        multi = C.pin(multi.select("key", "id", "hub"), "buckets")
    else:
        hubs = C.pin(member.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub < most").select("key", "hub"), "hubs")
        multi = C.pin(member.join(hubs, "key"), "buckets")
    texts = texts_of(multi.select("id").distinct())
    if sketched:
        words = ", ".join(f"s{k} long" for k in range(SKETCH))
        texts = texts.select("id", "text").mapInArrow(_sketcher(shingler), f"id long, text string, n long, {words}")
    texts = C.pin(texts, "texts")
    told = (lambda pairs: C.pin(not_far(pairs, texts, percent), "told")) if sketched else (lambda pairs: pairs)
    pairs = C.pin(multi.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    labels = C.components(C.pin(confirm(told(pairs), texts, shingler, percent), "links"))
    rooted = lambda rows: rows.join(labels, F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))
    several = lambda rows, key: rows.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(key)
    named = C.pin(rooted(multi.where("hub <> id").select("key", "id")), "named")
    wide = multi.select("key", "id")
    if sketched:
        left = C.pin(named.join(several(named, "key"), "key"), "left")
        sides = C.pin(minorities(left), "sides")
        pairs = pairs_of_few(left, sides.where(F.col("outside") <= FEW).select("key", "most"), texts, percent)
        links = C.pin(confirm(C.pin(pairs, "pairs"), texts, shingler, percent), "links")
        if not links.isEmpty():
            labels = merged(labels, links)
        large = sides.where(F.col("outside") > FEW).select("key")
        wide = C.pin(wide.join(large, "key"), "wide")
        named = C.pin(rooted(left.join(large, "key").select("key", "id")), "named")
    still = C.pin(named.join(several(named, "key"), "key").select("id").distinct(), "open")
    if still.isEmpty():
        return labels
    fine = prefixes(still, texts, shingler, percent)
    for salt in range(ROUNDS + 1):
        named = C.pin(rooted(fine), "named")
        fine = C.pin(named.join(several(named, "h"), "h"), "fine")
        if fine.isEmpty():
            break
        if salt < ROUNDS:
            hub = fine.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "h", "id").alias("by"), "id", "root", "n", "p")).alias("hub"))
            near = (F.col("root") != F.col("hub.root")) & possible(F.col("n"), F.col("p"), F.col("hub.n"), F.col("hub.p"), percent)
            pairs = fine.join(hub, "h").where(near).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
            links = confirm(told(C.pin(pairs, "pairs")), texts, shingler, percent)
        else:
            again = C.pin(rooted(wide.join(fine.select("id").distinct(), "id")), "open")
            links = rest(again.join(several(again, "key"), "key"), texts, shingler, percent)
        links, fine = C.pin(links, "links"), fine.drop("root")
        if not links.isEmpty():
            labels = merged(labels, links)
    return labels
