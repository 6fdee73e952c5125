"""Each operator against brute force on awkward rows: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passage_engine.llm import common as C
from passage_engine.llm import decontaminate, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, similarity, substring_dedup, token_counts, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, row string, size string, id string, block long, part string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, hot = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    texts = [base, " ".join(near), base, None, "", " \n\t ", "one", "one two", hot, "x\n" + hot + "\nx\n\nx", "Émile l'État İ ﬁ 中文 don't!! <|endoftext|> á", "a  b   c ▁ ", prose(rng, 9000), "the " * 400, "### $$$ " * 30]
    texts += [hot] * 20 + [base[:-3] + f"w{i} v{i}" for i in range(20)] + [prose(rng, rng.randint(1, 80)) + "\n" + hot for _ in range(20)] + [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    out = [(i, t, "en", [None, "b", "a", "é"][min(i % 7, 3)], len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [(*r, 1, 2, "r", "s", "i", 3, "p") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return C.pin(spark.createDataFrame(rows, SCHEMA).repartition(5), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    found = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in found}) == len(found)
    return {r["doc_id"]: r for r in found}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_windows_by_position():
    h = np.arange(50, dtype=np.uint64)
    for size in range(1, 20):
        w = C.windows(h, size)
        assert len(w) == 51 - size and (C.windows(h[9:], size) == w[9:]).all() and len(set(w.tolist())) == len(w)


def test_blocks_of_texts_beyond_the_limit():
    texts = ["a" * 10, None, "é" * 2_000_000, "", "b" * 3_000_000, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    parts = [x.column("id").to_pylist() for x in C.text_blocks(iter([batch]))]
    assert sum(parts, []) == list(range(6)) and all(len(x) == 1 or sum(len((texts[i] or "").encode()) for i in x) <= 2 << 20 for x in parts)
    assert C.as_bytes(batch.column("text"))[1] == b""


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))  # beyond text_blocks' limit
    own = spark.createDataFrame([(1, long), (2, long + " and more"), (3, "short one"), (4, long[:1_000_000])], "doc_id long, text string")
    found = by_id(near_dedup.near_duplicates(own))
    assert len(long) > 2 << 20 and {i: x["component_id"] for i, x in found.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    item = " ".join(long.split()[-40:])
    assert [tuple(r)[:2] for r in decontaminate.contaminated(own, spark.createDataFrame([(9, item)], "item_id long, text string")).orderBy("doc_id").collect()] == [(1, 9), (2, 9)]
    removed = by_id(substring_dedup.remove_substrings(own))
    assert removed[1]["n_removed"] == 0 and removed[2]["n_removed"] == 400_000 and removed[2]["n_words"] == 400_002
    assert by_id(mixing.word_counts(own.withColumn("source", F.lit("s")), []))[1]["size"] == 400_000


def test_prefix_sums_with_ties_and_nulls(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, *range(40)]), i, rng.randint(0, 9), rng.choice([None, "a", "b"])) for i in range(300)]
    df = C.pin(spark.createDataFrame(data, "k long, i long, v long, g string"), "p")
    for group in (None, "g"):
        found = {r["i"]: r["before"] for r in C.prefix_sums(df, "k", {"v": "before"}, group=group, ties=["i"]).collect()}
        for k, i, _, g in data:
            assert found[i] == sum(v for a, b, v, h in data if (group is None or h == g) and ((a is not None, a or 0, b) < (k is not None, k or 0, i)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(150, 139), (7, 7)]
    found = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 150: 100}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def bucket(spark, sets):
    def numbers(column):
        return [np.unique(np.array([int(x) for x in t.split()], np.uint64)) for t in column.to_pylist()]

    member = spark.createDataFrame([(1, i) for i in sets], "key long, id long")
    texts = spark.createDataFrame([(i, " ".join(map(str, sorted(s)))) for i, s in sets.items()], "id long, text string")
    found = similarity.components(member, lambda ids: texts.join(ids, "id", "left_semi"), lambda: numbers, 80)
    return {r["node"]: r["root"] for r in found.collect()}


def test_bucket_links_that_a_star_misses(spark):
    """The hub 0 is like nobody; the links among 1..9 are met only when the rest of the bucket is searched."""
    common = set(range(1_000, 1_040))
    sets = {i: {100 * i + k for k in range(20)} | common for i in range(10)}
    for a, b in ((1, 2), (3, 4), (4, 5), (8, 9)):
        sets[b] = {*list(sorted(sets[a]))[1:], 50_000 + b}
    assert bucket(spark, sets) == {2: 1, 4: 3, 5: 3, 9: 8}


def test_bucket_of_near_copies_and_strangers(spark, monkeypatch):
    """One bucket of 5,000 near copies, not all alike, and 5,000 strangers that share a passage with them: exact components from few pairs."""
    rng, pairs = random.Random(4), []
    base = list(range(100_000, 100_100))
    sets = {i: {x if rng.random() > 0.06 else rng.randrange(1 << 40) for x in base} for i in range(0, 10_000, 2)}
    sets |= {i: {*base[:50], *(rng.randrange(1 << 40) for _ in range(60))} for i in range(1, 10_000, 2)}
    whole = similarity.confirm
    monkeypatch.setattr(similarity, "confirm", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    found = bucket(spark, sets)
    left = {i for i in range(0, 10_000, 2) if found.get(i, i) != 0}
    assert all(i % 2 == 0 for i in found) and sum(pairs) < 250_000
    for i in left:  # whoever stayed alone is like no one
        assert not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(0, 10_000, 2) if j != i and found.get(j, j) != found.get(i, i))


@pytest.mark.parametrize("few", [0, 2, 256])
def test_sketches_rule_out_only_unlike_sets(spark, monkeypatch, few):
    """Buckets of chains of alike sets and strangers: with sketches the same components, from far fewer compared texts."""
    rng, sets, pairs = random.Random(5), {}, []
    for i in range(120):
        old = sets[i - 1] if i % 4 else {rng.randrange(1 << 40) for _ in range(rng.randint(1, 300))}
        sets[i] = {x if rng.random() > 0.07 else rng.randrange(1 << 40) for x in old}
    sets[200] = set()
    words = similarity.odd_sketches([np.array(sorted(x), np.uint64) for x in sets.values()])
    for (a, x), (b, y) in itertools.product(zip(sets.values(), words, strict=True), repeat=2):
        assert sum(int(p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)
    member = spark.createDataFrame([(k, i) for i in sets for k in (0, 1 + i % 3)], "key long, id long")
    texts = spark.createDataFrame([(i, " ".join(map(str, sorted(s)))) for i, s in sets.items()], "id long, text string")
    numbers = lambda: lambda column: [np.unique(np.array([int(x) for x in t.split()], np.uint64)) for t in column.to_pylist()]
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    whole = similarity.confirm
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "confirm", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    found = similarity.components(member, lambda ids: texts.join(ids, "id", "left_semi"), numbers, 80, sketched=True)
    assert {r["node"]: r["root"] for r in found.collect()} == {k: v for k, v in root.items() if k != v}
    assert sum(pairs) < len(sets) * 2


def test_lines_are_sifted_before_they_move(spark):
    own = spark.range(100_000).select(F.xxhash64("id").alias("ha"), "id")
    wanted = own.where("id % 1000 = 0").select("ha")
    some = {r["id"] for r in line_dedup.sifted(own, wanted).collect()}
    assert some >= set(range(0, 100_000, 1000)) and len(some) < 2_000
    assert line_dedup.sifted(own, wanted.limit(0)).count() == 0


def test_tables_leave_no_checksum_files(spark):
    """Hadoop starts chmod for a file and its checksum file; each start counts the executor's memory twice."""
    found = C.pin(spark.range(100).repartition(3), "plain")
    path = token_store.write_store(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), C.new_path(spark, "store"))
    folders = [Path(found.inputFiles()[0].removeprefix("file://")).parent, Path(path.removeprefix("file:"))]
    assert found.count() == 100 and all(any(d.rglob("*.parquet")) and not any(d.rglob("*.crc")) for d in folders)


def test_mixing_starts_no_chmod(spark, docs):
    folder = Path(C.shared_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    assert mixing.mix(docs).count() == docs.count()
    made = {f for f in folder.rglob("*.parquet") if f not in before and f.is_file()}
    assert made and not any(f.with_name(f".{f.name}.crc").exists() for f in made)


# ---------------------------------------------------------------- 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF) | st.sampled_from(" '.,!İ<|aésS\ń中\x1c\x85\xa0"), max_size=40))
def test_word_encoder_is_the_library(text):
    own = token_store._encoder("word_bpe_49k.json")
    ids, starts = own(pa.array([text, "a b", text], pa.string()))
    want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in (text, "a b", text)]
    assert own.by_word and [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == want


def test_crc_shares():
    rng = random.Random(2)
    parts = [rng.randbytes(rng.randint(0, 5000)) for _ in range(6)]
    sizes = np.array([len(p) for p in parts])
    shares = token_store.shifted(np.array([zlib.crc32(p) for p in parts]), sizes.sum() - np.cumsum(sizes))
    assert int(np.bitwise_xor.reduce(shares)) == zlib.crc32(b"".join(parts))


def test_token_store_round_trip(spark, docs, rows):
    path = token_store.write_store(docs, C.new_path(spark, "store"))
    tokenizer, start = token_store._tokenizer("word_bpe_49k.json"), 0
    found, whole = by_id(token_store.read_digests(spark, path)), by_id(token_store.read_documents(spark, path))
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert whole[doc_id]["ids"] == ids
        assert found[doc_id] == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    keys = token_store.chunks(spark, path).select("key")
    assert keys.count() == keys.distinct().count()
    assert token_store.verify_manifest(spark, path).count() == 0
    assert token_store.manifest(spark, path).agg(F.sum("tokens")).head()[0] == start


def test_token_store_of_nothing_and_repeated_rows(spark, empty):
    assert token_store.read_digests(spark, token_store.write_store(empty, C.new_path(spark, "store"))).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    found = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read_digests(spark, token_store.write_store(same, C.new_path(spark, "store"))).collect())
    assert found == [(0, None, 1), (1, 1, 3), (4, 1, 3)]


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 40_000, 20_000).astype(np.uint32)
    a = {ids[x:y].tobytes() for x, y in zip([0, *token_store.cut(ids)], token_store.cut(ids), strict=False)}
    moved = np.concatenate([ids[:777], ids[1:]])
    b = {moved[x:y].tobytes() for x, y in zip([0, *token_store.cut(moved)], token_store.cut(moved), strict=False)}
    assert len(a & b) > 0.8 * len(a)


# ---------------------------------------------------------------- 2


def test_line_dedup_is_brute_force(docs, rows):
    first, sets = {}, {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if split(line):
                first.setdefault(line, (doc_id, k))
    for line in first:
        sets[line] = {line[k : k + 8] for k in range(max(1, len(line) - 7))}
    parent = {x: x for x in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(first, key=first.get)
    for i, a in enumerate(order):
        for b in order[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)), key=first.get)
                parent[y] = x
    text_of = {r[0]: r[1] for r in rows}
    found = line_dedup.line_components(docs).collect()
    assert len(found) == sum(bool(split(x)) for r in rows if r[1] is not None for x in r[1].split("\n"))
    for r in found:
        rep = first[root(text_of[r["doc_id"]].split("\n")[r["line_no"]])]
        assert (r["rep_doc_id"], r["rep_line_no"]) == rep and r["kept"] == ((r["doc_id"], r["line_no"]) == rep)
    rest = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(docs).collect()}
    gone = {(r["doc_id"], r["line_no"]) for r in found if not r["kept"]}
    for doc_id, text in text_of.items():
        assert rest[doc_id] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone))


def test_line_dedup_reads_every_character(spark, docs, rows, tmp_path):
    from passage_engine.llm.queries import QUERIES

    extra = ["https://a.example/first/page/of/many", "https://b.example/other/things", "Invoice: 1000000012", "Invoice: 9876543210", "2024-01-01T00:00:00Z-started", "2024-01-01T23:59:59Z-stopped"]
    extra += ["東京都千代田区丸の内一丁目九番一号", "東京都千代田区丸の内二丁目四番一号で会いましょう", "short", "short", "x" * 40 + "abcdefghijklmnopqrstuvwxyz" * 3, "x" * 40 + "abcdefghijklmnopqrstuvwxyz" * 3 + "!", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢𝔰 𝔥𝔢𝔯𝔢"]
    texts = {r[0]: r[1] for r in rows} | {10_000 + k: x for k, x in enumerate(extra)}
    added = spark.createDataFrame([(10_000 + k, x) for k, x in enumerate(extra)], "doc_id long, text string")
    docs.unionByName(added, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for doc_id in sorted(texts):
        for k, line in enumerate(texts[doc_id].split("\n") if texts[doc_id] is not None else []):
            if split(line):
                first.setdefault(line, (doc_id, k))
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in first}
    order = sorted(first, key=first.get)
    root = {x: x for x in order}
    for i, a in enumerate(order):
        for b in order[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if root[a] != root[b] and 100 * small >= 80 * large and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]), key=first.get)
                root = {k: x if v == y else v for k, v in root.items()}
    found = {(r["doc_id"], r["line_no"]): r for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert len(found) == sum(bool(split(x)) for t in texts.values() if t is not None for x in t.split("\n"))
    for (doc_id, k), r in found.items():
        assert (r["rep_doc_id"], r["rep_line_no"]) == first[root[texts[doc_id].split("\n")[k]]] and r["kept"] == ((doc_id, k) == (r["rep_doc_id"], r["rep_line_no"]))
    assert [found[10_000 + k, 0]["kept"] for k in range(len(extra))] == [True] * 9 + [False, True, False, True, True]


def test_line_dedup_of_near_copies_and_strangers_is_native(spark, monkeypatch):
    """400 near copies, not all alike, and 100 strangers with a common passage: exact components from few pairs, without Python workers."""
    rng, pairs = random.Random(9), []
    base = prose(rng, 60).split()
    texts = [" ".join(w if rng.random() > 0.05 else "".join(rng.choice("abcdefgh") for _ in w) for w in base) for _ in range(400)]
    texts += [" ".join(base[:25]) + " " + prose(rng, 35) for _ in range(100)]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]

    def python(self, *a, **b):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, python)
    whole = line_dedup.confirmed
    monkeypatch.setattr(line_dedup, "confirmed", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    # one document twice: equal rows are one line
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    found = {r["doc_id"]: r["rep_doc_id"] for r in line_dedup.line_components(docs).collect()}
    assert found == dict(enumerate(root)) and len(set(root[:400])) > 1 and sum(pairs) < 20_000


@pytest.mark.parametrize("n", [5, 20, 200])
def test_bands_of_alike_lines(spark, n):
    """Pairs that share four fifths of their shingles, or as many as are needed, have a band in common: of 2,000 pairs, at most 8 don't."""
    rng = random.Random(n)
    made = [prose(rng, 100 + n)[: n + 7] for _ in range(2_000)]
    cut = max(1, n // 5)
    rows = [(2 * i + k, 0, x, i) for i, a in enumerate(made) for k, x in enumerate((a, a[: len(a) - cut]))]
    own = spark.createDataFrame(rows, "ha long, hb long, line string, place long")
    got = {r["ha"]: r for r in line_dedup.signed(own, ["ha", "hb"], line_dedup.CHARS, line_dedup.BANDS, line_dedup.ROWS).collect()}
    lost = sum(not any(got[2 * i][f"b{k}"] == got[2 * i + 1][f"b{k}"] for k in range(line_dedup.BANDS)) for i in range(2_000))
    assert len(got) == 4_000 and lost <= 8


def test_line_dedup_of_nothing(empty):
    assert line_dedup.line_components(empty).count() == 0


# ---------------------------------------------------------------- 3


def measured(text):
    w = split(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    counts = Counter(grams)
    covered = {k + i for k, g in enumerate(grams) if counts[g] > 1 for i in range(3)}
    own = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(covered)


def test_quality_rules_are_brute_force(docs, rows, empty):
    found = by_id(quality_rules.verdicts(docs))
    for r in rows:
        x = found[r[0]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == measured(r[1])
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert x["kept"] == (x["failures"] == 0)
    kept = {r["doc_id"] for r in quality_rules.keep_passing(docs).collect()}
    assert kept == {i for i, x in found.items() if x["kept"]} and quality_rules.keep_passing(docs).columns == docs.columns
    assert quality_rules.verdicts(empty).count() == 0


def test_quality_ablations(docs):
    own = quality_rules.ledger(docs)
    bits = [r["failures"] for r in own.select("failures").collect()]
    for r in quality_rules.ablations(own).collect():
        bit = quality_rules.mask((r["rule"],))
        assert (r["failed"], r["failed_alone"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


# ---------------------------------------------------------------- 4


def test_token_counts_are_the_library(docs, rows, empty):
    found, library = by_id(token_counts.token_counts(docs)), token_counts._processor("piece_bpe_32k.model")
    for r in rows:
        n = len(library.encode(r[1] or ""))
        assert found[r[0]] == {"doc_id": r[0], "n_bytes": len((r[1] or "").encode()), "n_tokens": n, "over_limit": n > 4096}
    assert token_counts.token_counts(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ab\n\t.é☃▁中zq<s>　"), max_size=30))
def test_shortcut_is_the_library(text):
    own = token_counts._shortcut("piece_bpe_32k.model")
    assert own.splits and own.count(text.encode()) == len(own.processor.encode(text))


# ---------------------------------------------------------------- 5


def test_contamination_is_brute_force(spark, docs, rows, empty):
    rng = random.Random(5)
    long = [r[1].split() for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(w[a : a + rng.choice([3, 5, 9, 20])])) for i, w in enumerate(long[:25]) for a in [rng.randrange(len(w) - 20)]]
    items += [(90, " ".join(long[0][:20] + ["new"] + long[0][21:26])), (91, None), (92, ""), (93, "nowhere to be seen at all here"), (94, long[3][0])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        q = (t or "").lower().split()
        if q:
            own = grams(q, min(5, len(q)))
            for r in rows:
                k = len(own & grams([x.lower() for x in split(r[1])], min(5, len(q))))
                if k >= 0.8 * len(own) - 1e-9:
                    want.add((r[0], i, len(own), k))
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
    rest = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in rest.collect()} == {r[0] for r in rows} - {x[0] for x in want} and rest.columns == docs.columns
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_in_blocks(spark, docs, monkeypatch):
    bench = docs.where("length(text) > 50").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 90).alias("text"))
    one = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8_000)
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == one


def test_items_are_partitioned_by_size():
    word = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    items = decontaminate.Items([(1, word(1, 7)), (2, word(2, 34)), (3, word(3, 304)), (4, word(4, 3)), (5, word(2, 34))], 5, 0.8)
    sizes = {run: {p.bound: len(p.keys) for p in own.values()} for run, own in items.partitions.items()}
    # 3, 30 and 300 shingles lie in partitions of bounds 4, 32 and 512, whose sketches have floor(bound / 5) + 1 hashes
    assert sizes == {5: {4: 1, 32: 7, 512: 103}, 3: {1: 1}}
    assert {p.least for p in items.partitions[5].values()} == {3, 24, 240}


def test_contamination_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "a b"), (3, None)], "item_id long, text string")
    rows = [(None, "x one two three four five six", "p"), (7, "a b", "q"), (7, "a b", "q"), (8, None, "r"), (9, "", "s")]
    own = spark.createDataFrame(rows, "doc_id long, text string, row_no string")
    want = sorted([(None, 1, 2, 2)] * 2 + [(7, None, 1, 1)] * 2, key=str)
    for limit in (decontaminate.BLOCK_BYTES, 128):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        assert sorted((tuple(r) for r in decontaminate.contaminated(own, bench).collect()), key=str) == want
        rest = decontaminate.decontaminate(own, bench)
        assert rest.columns == own.columns and sorted(r["doc_id"] for r in rest.collect()) == [8, 9]


# ---------------------------------------------------------------- 6


def test_substring_dedup_is_brute_force(docs, rows, empty):
    first = {}
    for r in sorted(rows):
        w = split(r[1])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r[0])
    found = by_id(substring_dedup.remove_substrings(docs))
    for r in rows:
        w = split(r[1])
        gone = {k + i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r[0] for i in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert found[r[0]] == {"doc_id": r[0], "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()}
    assert substring_dedup.remove_substrings(empty).count() == 0


def test_substring_dedup_with_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string")
    found = Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_substrings(df).collect())
    assert found == {(None, 0): 1, (4, 20): 2, (5, 0): 1}


# ---------------------------------------------------------------- 7


def shingles(text):
    w = [x.translate(str.maketrans(C.UPPER, C.LOWER)) for x in split(text)]
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def test_near_dedup_is_brute_force(docs, rows, empty):
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    found = by_id(near_dedup.near_duplicates(docs))
    for i, s in sets.items():
        assert found[i] == {"doc_id": i, "n_shingles": len(s), "component_id": comp[i], "kept": comp[i] == i}
    rest = near_dedup.keep_first(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in rest.collect()) == sorted({*comp.values()}) and rest.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_permutation_estimates():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 400):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: max(1, int(0.9 * n))], rng.integers(0, 1 << 63, max(0, n // 10)).astype(np.uint64)]))
        same = (near_dedup.one_permutation(x, 160) == near_dedup.one_permutation(y, 160)).mean()
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(same - truth) < (0.6 if n < 10 else 0.25)


# ---------------------------------------------------------------- 8


def test_targets_stop_and_reshare():
    got = mixing.targets([100, 100, 10, 0], [1, 2, 3, 1])
    assert sum(got) == pytest.approx(210) and got[2] == 30 and got[1] == pytest.approx(2 * got[0]) and got[3] == 0
    assert mixing.targets([], []) == []


def test_permutation_and_draws():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    counts = mixing.draw([500, 0, 300], 7, 1)
    assert counts.sum(0).tolist() == [500, 0, 300] and counts.sum(1).max() - counts.sum(1).min() <= 1


def test_mixture(docs, rows, empty):
    found = by_id(mixing.mix(docs))
    sizes = {r[0]: len(split(r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {s: sum(sizes[r[0]] for r in rows if r[3] == s) for s in names}
    want = dict(zip(names, mixing.targets(list(total.values()), [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in rows:
        x = found[r[0]]
        assert (x["size"], x["source_size"]) == (sizes[r[0]], total[r[3]]) and x["target"] == pytest.approx(want[r[3]]) and 0 <= x["taken"] <= 3 * x["size"]
        taken[r[3]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in names)
    mixed = mixing.mixed_documents(docs)
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(split(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert mixed.columns == docs.columns and {i: n for i, n in words.items() if n} == {i: x["taken"] for i, x in found.items() if x["taken"]}
    assert by_id(mixing.mix(docs)) == found and mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_mixture_of_more_sources_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 7)
    monkeypatch.setattr(mixing, "SENT", 20)
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.choice([3, 40, 900]))), None if i % 41 == 40 else f"s{i % 41:02d}") for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, again = mixing.mix(own).collect(), mixing.mix(own.repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in names}
    want = dict(zip(names, mixing.targets(list(total.values()), [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken, of = Counter(), {r[0]: r[2] for r in rows}
    for r in found:
        assert r["target"] == pytest.approx(want[of[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    assert len(names) == 41 and all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in names)
    mixture = mixing.Mixture(C.pin(mixing.word_counts(own, []), "sizes"))
    shards = Counter(r["shard"] for r in mixture.plan.collect())
    assert len(shards) == mixing.SHARDS and max(shards.values()) - min(shards.values()) <= 1


def test_mixture_edges(spark):
    rows = [(None, "a b c", "x", 1, 2), (None, "a b c", "x", 1, 2), (3, "d e", None, 1, 2), (3, "d  e", None, 1, 2), (4, None, "y", 1, 2), (5, "", "z", 1, 2)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, __doc int, row int")
    got = sorted((tuple(r) for r in mixing.mix(own).collect()), key=str)
    assert got == sorted((tuple(r) for r in mixing.mix(own.repartition(3)).collect()), key=str) and len(got) == 6
    mixed = mixing.mixed_documents(own)
    assert mixed.columns == own.columns and all((r["__doc"], r["row"]) == (1, 2) for r in mixed.collect())


# ---------------------------------------------------------------- 9


def test_sharding(spark, docs, rows, empty):
    found = by_id(sharding.assign(docs))
    total, before, slots = sum(len((r[1] or "").encode()) + 1 for r in rows), 0, Counter()
    for r in sorted(rows):
        data = (r[1] or "").encode()
        size = len(data) + 1
        shard = min(15, (2 * before + size) * 16 // (2 * total))
        assert found[r[0]] == {"doc_id": r[0], "size": size, "text_crc32": zlib.crc32(data), "law": "bytes", "shard": shard, "slot": slots[shard], "grown_shard": None}
        before, slots = before + size, slots + Counter([shard])
    assert sharding.assign(empty).count() == 0
    sharding.write_shards(docs, path := C.new_path(spark, "shards"), 4)
    assert spark.read.parquet(path).count() == len(rows)


# ---------------------------------------------------------------- 10


def test_classifier_learns_and_ignores_ids(spark, sf):
    docs, labels = C.load(spark, sf.replace("0.001", "0.01"), "documents"), C.load(spark, sf.replace("0.001", "0.01"), "labels")
    found = by_id(quality_classifier.score(docs, quality_classifier.train(docs, labels)))
    right = [(found[r["doc_id"]]["predicted"] == r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert sum(right) >= 0.9 * len(right)
    for i, x in found.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality_classifier.train(docs, none)
    assert {r["score"] for r in quality_classifier.score(docs, trees).collect()} == {0.5}
    assert quality_classifier.score(empty, trees).count() == 0


def test_first_split_is_brute_force(monkeypatch):
    monkeypatch.setattr(quality_classifier, "TREES", 1)
    monkeypatch.setattr(quality_classifier, "DEPTH", 1)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, size=(300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 25] = 1
    trees = quality_classifier.fit(x, y)
    g, h = y.mean() - y, np.full(len(y), y.mean() * (1 - y.mean()))
    of = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)
    gains = {}
    for f in range(3):
        for c in np.unique(x[:, f]):
            low = x[:, f] <= c
            if min(low.sum(), (~low).sum()) >= quality_classifier.LEAST:
                gains[f, c] = of(low) + of(~low) - of(np.ones(len(y), bool))
    f, c = int(trees.feature[0, 0]), float(trees.cut[0, 0])
    low = x[:, f] <= c  # all 40 values are bins, so no split is better than the best of all
    assert of(low) + of(~low) - of(np.ones(len(y), bool)) == pytest.approx(max(gains.values()))
    assert trees.value[0].tolist() == pytest.approx([-quality_classifier.RATE * g[a].sum() / (h[a].sum() + 1) for a in (low, ~low)])


def test_classifier_edges(spark):
    rows = [(1, "good words here", "x"), (1, "other text of the same id", "x"), (2, "bad # # #", "y"), (2, "bad # # #", "y"), (None, None, "z"), (3, "", "z"), (4, None, "z")]
    own = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    a, b = (quality_classifier.train(d, labels) for d in (own, own.repartition(4)))
    assert (a.base, a.cut.tolist(), a.value.tolist()) == (b.base, b.cut.tolist(), b.value.tolist())
    got = quality_classifier.score(own, a).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert quality_classifier.score(own, quality_classifier.train(own.limit(0), labels)).count() == len(rows)


def test_flat_trees_walk_like_branches():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 1] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = quality_classifier.fit(x, y)

    def walk(row):
        total = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            k = 0
            for _ in range(quality_classifier.DEPTH):
                k = 2 * k + (2 if row[feature[k]] > cut[k] else 1)
            total += value[k - len(feature)]
        return 1 / (1 + np.exp(-total))

    score = trees.score(x)
    assert np.allclose(score, [walk(r) for r in x]) and ((score > 0.5) == y).mean() > 0.97


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, docs, sf, empty):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    for start in (docs, empty):
        own = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            own = C.pin(stage(spark, own, sf), "stage")
            assert k == 4 or own.columns == docs.columns
        assert own.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_near_duplicates_by_five_words(spark, sf):
    import corpus_pipeline

    docs = C.load(spark, sf, "documents")
    base = prose(random.Random(8), 100).split()
    near, far = base.copy(), base.copy()
    near[50] = "changed"
    for k in (10, 25, 40, 55, 70):
        far[k] = f"v{k}"
    added = spark.createDataFrame([(900_001, " ".join(base)), (900_002, " ".join(near)), (900_003, " ".join(far))], "doc_id long, text string")
    docs = C.pin(docs.unionByName(added, allowMissingColumns=True), "docs")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, t in texts.items() for w in [[x.translate(str.maketrans(C.UPPER, C.LOWER)) for x in split(t)]]}
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).collect()}
    assert kept == {*comp.values()} and {900_001, 900_003} <= kept and 900_002 not in kept
