"""Token-ID output into a content-addressed store.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream into chunks wherever the hash falls in
a fixed class, so equal passages give equal chunks wherever they stand. A chunk is stored once under its digest;
a document is a *recipe*: the digests and lengths of its chunks. Recipes stand in ascending doc_id order with the
stream offset of their first id, and every recipe file has a Merkle root in the manifest.

Layout of a store (all Parquet; binary columns are little-endian)::

    raw/kind=0     key, n, payload             unique chunks; payload: n ids of ``width`` bytes
    raw/kind=1     the recipes as encoded
    recipes/       doc_id, start, n_tokens, keys (16 bytes a chunk), lens (uint32 a chunk), root
    manifest/      first, last, docs, tokens, root     a row for each run of recipes

Bounds: a task holds one slice of texts, 200,000 digests of chunks it has sent, and one Arrow batch; a worker also
``WordTable.LIMIT`` strings with their ids.
Nulls and empty texts: the end id alone. Repeated rows and repeated doc_ids: each row is a document of its own,
ordered by (doc_id, root), nulls first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine.llm import common as C

WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 2048
RAW = "kind int, route binary, key binary, n long, payload binary, doc_id long, keys binary, lens binary, root binary"
_RAW = pa.schema([("kind", pa.int32()), ("route", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("lens", pa.binary()), ("root", pa.binary())])


@lru_cache(2)
def _tokenizer(name: str):
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


#: Marks that never belong to a letter run or a contraction.
MARKS = ".,;:!?*$%&#|)]}"
#: What the word-wise path below relies on, as the tokenizer's own file states it; fixed values.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "rest": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
}


def splits_at_spaces(tokenizer) -> bool:
    """Whether the tokenizer's file says that a text's ids are those of its white-space-free strings in a row."""
    own = json.loads(tokenizer.to_str())
    pre = own["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers") or [{}, {}]
    cut = steps[0].get("type") == "Split" and steps[0].get("pattern") == SPLITS["pattern"] and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
    plain = own["post_processor"] is None and own["truncation"] is None and own["padding"] is None
    return plain and own["normalizer"] == SPLITS["normalizer"] and cut and steps[1:] == [SPLITS["rest"]] and all(t["content"].startswith("<|") for t in own["added_tokens"])


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of UTF-8 texts that go to the library whole: with combining marks or what lies beyond them (lead bytes from
    0xCC), the one letter that folds to a mark (U+0130), other spaces (U+0085, U+00A0) or the start of a special string."""
    at = [np.flatnonzero(data >= 0xCC)]
    for lead, nexts in ((0xC4, (0xB0,)), (0xC2, (0x85, 0xA0)), (ord("<"), (ord("|"),))):
        found = np.flatnonzero(data[:-1] == lead)
        at.append(found[np.isin(data[found + 1], nexts)])
    rows = np.searchsorted(offsets, np.concatenate(at), "right") - 1
    return np.unique(rows[(rows >= 0) & (rows < len(offsets) - 1)])


def strings_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


class WordTable:
    """Ids of strings, found by two independent 64-bit hashes of their bytes; about 30 bytes a string.

    A hash is a sum over bytes of a random number for the byte times a random odd number for its place, so strings
    fall together with a chance of about 2**-120 a pair. Strings over ``MOST`` bytes aren't kept.
    """

    MOST, LIMIT = 48, 1_200_000
    _r = np.random.default_rng(20_240_229)
    BYTE = _r.integers(0, 1 << 64, (2, 256), np.uint64)
    PLACE = _r.integers(0, 1 << 64, (2, MOST + 1), np.uint64) | np.uint64(1)

    def __init__(self):
        self.key, self.check, self.at = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.flat, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.uint32)
        self.n = 0

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each string of at most ``MOST`` bytes (others: of its first bytes, not to be used)."""
        data, offsets = strings_of(column)
        n = np.minimum(np.diff(offsets), self.MOST).astype(np.int64)
        starts = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(starts, n)
        own = data[np.repeat(offsets[:-1], n) + place]
        out, full = [], n > 0
        for k in range(2):
            h = self.PLACE[k][self.MOST] * n.astype(np.uint64)
            if full.any():
                h[full] += np.add.reduceat(self.BYTE[k][own] * self.PLACE[k][place], starts[full])
            out.append(C.mix(h))
        return out[0], out[1]

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known strings, and which are known."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        order = np.argsort(key)  # in order, neighbours look in the same places
        k = np.empty(len(key), np.int64)
        k[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return self.at[k].astype(np.int64), (self.key[k] == key) & (self.check[k] == check)

    def put(self, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keep id lists of these lengths; their numbers."""
        used = int(self.ends[self.n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(n) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + len(n) + 1] = used + np.cumsum(n)
        self.n += len(n)
        return np.arange(self.n - len(n), self.n)

    def name(self, key: np.ndarray, check: np.ndarray, at: np.ndarray) -> None:
        """Strings of these hashes have these numbers from now on."""
        order = np.argsort(key, kind="stable")
        key, check, at = key[order], check[order], at[order].astype(np.uint32)
        to = np.searchsorted(self.key, key)
        self.key, self.check, self.at = np.insert(self.key, to, key), np.insert(self.check, to, check), np.insert(self.at, to, at)

    def lists(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings of these numbers in a row, and where each ends, from 0."""
        first = self.ends[at].astype(np.int64)
        n = self.ends[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of texts by the library, one call for each distinct white-space-free string.

    A tokenizer that drops white space before it splits, composes and lower-cases each character by itself, and has
    no merge over a gap gives a text the ids of its strings in a row; ``splits_at_spaces`` holds its file against that.
    Texts with characters beyond those of plain composed scripts, or with special strings, go to the library whole,
    as do all texts of any other tokenizer.
    """

    def __init__(self, name: str):
        self.tokenizer = _tokenizer(name)
        self.by_word = splits_at_spaces(self.tokenizer)
        self.table = WordTable()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array without nulls in a row, and where each text's begin (one more entry than texts)."""
        odd = odd_rows(*strings_of(texts)) if self.by_word else np.arange(len(texts))
        at_odd = np.zeros(len(texts), bool)
        at_odd[odd] = True
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(at_odd), "", texts)))  # ASCII letters only, which the tokenizer folds too
        coded = lists.flatten().dictionary_encode()
        ids, ends = self._of(coded.dictionary, coded.indices.to_numpy())
        cuts = ends[lists.offsets.to_numpy()]
        if not len(odd):
            return ids, cuts
        extra = [self.whole(texts[int(k)].as_py()) for k in odd]
        parts, at = [], 0
        for k, x in zip(odd.tolist(), extra, strict=True):
            parts += [ids[at : cuts[k]], x]
            at = cuts[k]
        n = np.diff(cuts)
        n[odd] += [len(x) for x in extra]
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(n)])

    def _of(self, words: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table.n > self.table.LIMIT:
            self.table = WordTable()
        return self.table.lists(self._numbers(words, True)[index])

    def _numbers(self, words: pa.Array, split: bool) -> np.ndarray:
        """Numbers of distinct strings; those seen for the first time are encoded and kept."""
        key, check = self.table.hashes(words)
        at, known = self.table.find(key, check)
        long = pc.binary_length(words).to_numpy() > self.table.MOST
        new = np.flatnonzero(~known | long)
        if not len(new):
            return at
        fresh = words.take(pa.array(new))
        # marks after a letter are a piece of their own: what stands before them is encoded once for all its endings
        stems = pc.ascii_rtrim(fresh, characters=MARKS) if split else fresh
        n_stem, n_all = pc.binary_length(stems).to_numpy(), pc.binary_length(fresh).to_numpy()
        apart = (n_stem < n_all) & pc.match_substring_regex(stems, r"\pL$").to_numpy(zero_copy_only=False)
        if apart.any():
            at_apart = np.flatnonzero(apart)
            marks = pa.array([w[k:] for w, k in zip(fresh.take(pa.array(at_apart)).to_pylist(), pc.utf8_length(stems.take(pa.array(at_apart))).to_pylist(), strict=True)], pa.string())
            pairs = []
            for part in (stems.take(pa.array(at_apart)), marks):
                coded = part.dictionary_encode()
                pairs.append(self._numbers(coded.dictionary, False)[coded.indices.to_numpy()])
            ids, ends = self.table.lists(np.stack(pairs, 1).ravel())
            at[new[at_apart]] = self.table.put(np.diff(ends).reshape(-1, 2).sum(1), ids)
        rest = np.flatnonzero(~apart)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(fresh.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at[new[rest]] = self.table.put(n, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())))
        kept = new[~long[new]]
        if split:  # a stem may be one of these strings itself and be kept by now
            kept = kept[~self.table.find(key[kept], check[kept])[1]]
        self.table.name(key[kept], check[kept], at[kept])
        return at


@lru_cache(1)
def _encoder(name: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(name)


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Where in a run of ids a chunk may end: after each window whose hash falls in one class of ``MEAN - LEAST``."""
    return np.flatnonzero(C.windows(ids.astype(np.uint64), WINDOW, 0xD1342543DE82EF95) % np.uint64(MEAN - LEAST) == 0) + WINDOW


def cut(ids: np.ndarray, marks: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one id stream: content-defined, ``LEAST`` to ``MOST`` ids long but for the last. ``marks``: those of ``ids``."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    marks = marks_of(ids) if marks is None else marks
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


class Merkle:
    """Root of the binary hash tree over leaves that come one by one; an odd last node moves up as it is. Keeps a node a level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.nodes and self.nodes[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.nodes.pop()[1] + node[1]).digest())
        self.nodes.append(node)

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        out = self.nodes[-1][1]
        for _, node in reversed(self.nodes[:-1]):
            out = hashlib.sha256(b"\1" + node + out).digest()
        return out


def merkle(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def encoder(tokenizer: str, end_id: int, width: int):
    kind = np.uint16 if width == 2 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sent = _encoder(tokenizer), set()
        for batch in C.text_blocks(batches, limit=4 << 20):
            ids, starts = ids_of(pc.fill_null(batch.column("text"), ""))
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            data, marks = memoryview(ids.astype(kind).tobytes()), marks_of(ids)
            first = np.searchsorted(marks, starts[:-1] + WINDOW).tolist()  # marks before are of windows that reach into the text before
            last = np.searchsorted(marks, starts[1:], "right").tolist()
            keys, ns, payloads = [], [], []
            docs, totals, names, lens, roots, routes = batch.column("doc_id").to_pylist(), np.diff(starts), [], [], [], []
            for doc, a, b, i, j in zip(docs, starts.tolist(), starts[1:].tolist(), first, last, strict=False):
                own, sizes, at = [], [], a
                for to in cut(range(b - a), marks[i:j] - a):
                    payload = data[at * width : (a + to) * width]
                    own.append(key := hashlib.blake2b(payload, digest_size=16).digest())
                    sizes.append(a + to - at)
                    if key not in sent:  # once for each task, as far as it remembers; the shuffle brings together what is sent again
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(key)
                        keys.append(key)
                        ns.append(a + to - at)
                        payloads.append(payload)
                    at = a + to
                names.append(b"".join(own))
                lens.append(np.array(sizes, "<u4").tobytes())
                roots.append(merkle(own))
                routes.append(hashlib.blake2b(roots[-1] + str(doc).encode(), digest_size=16).digest())
            m, n = len(keys), len(docs)
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(keys, pa.binary()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(payloads, pa.binary()), *(none(m, f.type) for f in list(_RAW)[5:])], schema=_RAW)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(routes, pa.binary()), none(n, pa.binary()), pa.array(totals), none(n, pa.binary()), batch.column("doc_id"), pa.array(names, pa.binary()), pa.array(lens, pa.binary()), pa.array(roots, pa.binary())], schema=_RAW)

    return encode


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one partition, in order of their keys, each once; recipes as they are."""
    last = None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        keep = [k is None or k != before for k, before in zip(keys, [last, *keys], strict=False)]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep))


_MANIFEST = "first long, last long, docs long, tokens long, root binary"
_RUN = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One manifest row for each recipe file; a partition has whole files, their recipes in order."""
    now, tree, first, last, docs, tokens = None, None, 0, 0, 0, 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, docs, tokens, tree.root())], schema=_RUN)
    for batch in batches:
        for file, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_tokens", "root")), strict=True):
            if file != now:
                if docs:
                    yield done()
                now, tree, first, docs, tokens = file, Merkle(), start, 0, 0
            tree.add(root)
            last, docs, tokens = start, docs + 1, tokens + n
    if docs:
        yield done()


def _recipe_runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as the recipe files give it."""
    ordered = spark.read.schema(RECIPES).parquet(f"{path}/recipes").withColumn("file", F.col("_metadata.file_path"))
    runs = ordered.select("file", "start", "n_tokens", "root").repartition(C.n_partitions(spark), "file").sortWithinPartitions("file", "start")
    return runs.mapInArrow(_runs, _MANIFEST)


def write_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, width: int = 2) -> str:
    """Encode ``docs`` (doc_id, text) into a store at ``path``; ``width``: bytes an id, 2 if every id is below 65,536."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    if width not in (2, 4) or width == 2 and max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16:
        raise ValueError("ids don't fit in this width")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoder(tokenizer, end_id, width), RAW)
    raw = raw.repartition(C.n_partitions(spark), "route").sortWithinPartitions("route").mapInArrow(_first_of_each, RAW).drop("route")
    raw.write.partitionBy("kind").options(**C.NO_CHILDREN).option("compression", "zstd").parquet(f"{path}/raw")
    recipes = _raw(spark, path, 1).select("doc_id", F.col("n").alias("n_tokens"), "keys", "lens", "root")
    placed = C.prefix_sums(recipes, "doc_id", {"n_tokens": "start"}, ties=["root"])
    placed.repartitionByRange(C.n_partitions(spark), "start").sortWithinPartitions("start").write.options(**C.NO_CHILDREN).parquet(f"{path}/recipes")
    _recipe_runs(spark, path).write.options(**C.NO_CHILDREN).parquet(f"{path}/manifest")
    return path


RECIPES = "doc_id long, n_tokens long, keys binary, lens binary, root binary, start long"


def _raw(spark: SparkSession, path: str, kind: int) -> DataFrame:
    schema = "key binary, n long, payload binary, doc_id long, keys binary, lens binary, root binary, kind int"
    return spark.read.schema(schema).parquet(f"{path}/raw").where(F.col("kind") == kind)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path, 0).select("key", "n", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, key, n, after) for each chunk of each recipe, ``after``: ids that follow it in its document; checks the root."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for start, keys, lens, root in zip(*(batch.column(c).to_pylist() for c in ("start", "keys", "lens", "root")), strict=True):
            own = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            if merkle(own) != root:
                raise ValueError(f"the recipe at {start} doesn't match its Merkle root")
            n = np.frombuffer(lens, "<u4").astype(np.int64)
            out[0] += [start] * len(own)
            out[1] += own
            out[2] += n.tolist()
            out[3] += (n.sum() - np.cumsum(n)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["start", "key", "n", "after"])


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, crcs, ns = batch.column("key").to_pylist(), [], []
            for key, payload in zip(keys, batch.column("payload").to_pylist(), strict=True):
                if hashlib.blake2b(payload, digest_size=16).digest() != key:
                    raise ValueError("a stored chunk doesn't match its digest")
                ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                ns.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(crcs, pa.int64()), pa.array(ns, pa.int64())], ["key", "crc", "stored"])

    return run


@lru_cache(1)
def _shifts() -> np.ndarray:
    """tables[k][byte][value]: what 2**k zero bytes that follow make of a CRC-32's byte; each table is the one before applied twice."""
    value = np.arange(256, dtype=np.uint32)
    one = value.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    # one zero byte: crc -> table[low byte] ^ crc >> 8
    first = np.stack([one ^ 0, value, value << np.uint32(8), value << np.uint32(16)]).astype(np.uint32)
    tables = [first]
    for _ in range(47):
        tables.append(_shift(tables[-1], tables[-1]))
    return np.stack(tables)


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of each chunk's share in a stream in which ``n_bytes`` more bytes follow; a stream's CRC is the XOR of the shares."""
    out, k = crc.astype(np.uint32), 0
    while (n_bytes >> k).any():
        on = (n_bytes >> k) & 1 == 1
        out[on] = _shift(_shifts()[k], out[on])
        k += 1
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("n"), pa.array(shifted(crc, after * 4).astype(np.int64))], ["start", "n", "share"])


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored chunks and recipes.

    Each chunk is read, held against its digest and reduced to the CRC-32 of its ids once, however often recipes
    name it; a document's CRC-32 is composed from those of its chunks. Fails if a chunk is missing or altered, or if
    the recipes aren't those of the manifest.
    """
    if (wrong := verify_manifest(spark, path).head()) is not None:
        raise ValueError(f"manifest and recipes don't agree from position {wrong['first']} on")
    own = recipes(spark, path)
    pieces = own.select("start", "keys", "lens", "root").mapInArrow(_pieces, "start long, key binary, n long, after long")
    stored = chunks(spark, path).mapInArrow(_digests(width), "key binary, crc long, stored long")
    found = pieces.hint("merge").join(stored, "key", "left")
    whole = F.when(F.col("stored") == F.col("n"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long"))
    shares = found.select("start", "n", "after", whole.alias("crc")).mapInArrow(_shares, "start long, n long, share long")
    crcs = shares.groupBy("start").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("n_read"))
    return own.select("doc_id", "start", "n_tokens").join(crcs, "start").select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids array<int>) rebuilt from the store."""
    pieces = recipes(spark, path).select("start", "keys", "lens", "root").mapInArrow(_pieces, "start long, key binary, n long, after long")
    found = pieces.hint("merge").join(chunks(spark, path).select("key", "payload"), "key")
    bodies = found.groupBy("start").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("o"), "payload"))).alias("parts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), "<u2" if width == 2 else "<u4").astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["start", "ids"])

    return recipes(spark, path).select("doc_id", "start").join(bodies.mapInArrow(build, "start long, ids array<int>"), "start").select("doc_id", "start", "ids")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Runs of recipes on which the manifest and the recipe files don't agree (a row of either); none in an intact store."""
    kept, found = manifest(spark, path), _recipe_runs(spark, path)
    same = ["first", "last", "docs", "tokens", "root"]
    return kept.join(found, same, "left_anti").unionByName(found.join(kept, same, "left_anti"))
