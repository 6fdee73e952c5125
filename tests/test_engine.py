"""The engine against literal expectations and a stepwise restatement of its rules."""

import csv
import glob
import json
import math
import random
import re
import threading
import urllib.error
import urllib.request
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passage_engine import api, cli, providers
from passage_engine.config import CLASSIC, CloudSettings
from passage_engine.functions import text as T
from passage_engine.operators import answers, chunking, dense, evaluation, groundtruth, sparse
from passage_engine.operators.topk import top_k
from passage_engine.plans.engine import Engine, generate_ground_truth, search
from passage_engine.sources import readers, writers
from passage_engine.streaming import stream

ODD = ["", "  \t ", "l'État", "3.14", "n°5", "²x", "_a_b_", "😀 a", "é!", "a\x1cb\x85c\xa0d", "A. B! C? D", "Fin.\n\nSuite", "a , b ( c ) .", "x" * 50]
PAGES = "collection_id string, source_file string, page int, text string"


def python_tokens(text):
    return re.findall(r"\w+|[^\w\s]", text)


def python_join(parts):
    out = ""
    for k, t in enumerate(parts):
        out += (" " if k and re.match(r"\w", t) and re.match(r"\w", parts[k - 1]) else "") + t
    return out


def one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def pages_of(spark, texts, collection="c"):
    return spark.createDataFrame([(collection, f"f{i:03d}", 1, t) for i, t in enumerate(texts)], PAGES)


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(9)
    return ODD + ["".join(rng.choice("ab é_1.,!? \n\t'-") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_tokens_and_join(spark, strings):
    assert one(spark, strings, T.tokens) == [python_tokens(s) for s in strings]
    joined = one(spark, strings, lambda c: T.join_tokens(T.tokens(c)))
    assert joined == [python_join(python_tokens(s)) for s in strings]
    assert one(spark, joined, T.tokens) == [python_tokens(s) for s in strings]


def test_sentences_and_strip(spark, strings):
    assert one(spark, strings, T.sentences) == [re.split(r"(?<=[.!?])\s+", s) for s in strings]
    assert one(spark, strings, T.strip) == [s.strip() for s in strings]
    assert one(spark, ["A b. C d! E"], lambda c: T.sentences(T.join_tokens(T.tokens(c)))) == [["A b.C d!E"]]


HEADED = "intro\nArticle 12 \nbody one\nSection 3bis\nbody two\n\nhello world\n\nÉlan vital\nSection\n5\nlast"


def test_headings(spark):
    restated = re.compile(r"^(\s*(?:Article\s+\d+|Section\s+\d+|Chapitre\s+\d+|[A-Z][A-Z0-9 \-]{4,}))\s*$", re.I | re.M)
    texts = [HEADED, "\n\nabcde\n\n\nArticle  7\n, \n ſection ٣\nİstanbul", "no, nothing."]
    assert one(spark, texts, T.heading_titles) == [[m[1].strip() for m in restated.finditer(t)] for t in texts]
    got = one(spark, ["a\nCHAPITRE I - X\nbody, one.\nArticle ٣\nb.", "no headings, at all.", "Article 1 - Champ d'application\n"], T.heading_titles)
    assert got == [["CHAPITRE I - X", "Article ٣"], [], []]
    parts = one(spark, ["a,\nTITRE UN\nbody, one.\nTITRE DEUX\n", "plain, text."], T.segments)
    assert [[(s["title"], s["body"].strip()) for s in p] for p in parts] == [[("TITRE UN", "body, one."), ("TITRE DEUX", "")], [(None, "plain, text.")]]


def stepwise(n, size, step):
    out, start = [], 0
    while start < n:
        out.append((start, min(start + size, n)))
        if out[-1][1] == n:
            break
        start += step
    return out


@pytest.mark.parametrize(("size", "step"), [(5, 3), (5, 5), (4, 6), (1, 1), (10, 2)])
def test_windows(spark, size, step):
    pages = pages_of(spark, ["w " * n for n in range(25)])
    rows = chunking._cut(chunking._whole(pages), "x", size, step).collect()
    for n in range(25):
        own = sorted((r["start"], r["end"]) for r in rows if r["source_file"] == f"f{n:03d}")
        assert own == stepwise(n, size, step)
        assert all(r["text"] == " ".join("w" * (r["end"] - r["start"])) for r in rows if r["source_file"] == f"f{n:03d}")


def test_windows_must_move(spark):
    pages = pages_of(spark, ["a"])
    for bad in (lambda: chunking.fixed(pages, 5, 5), lambda: chunking.fixed(pages, 5, -1), lambda: chunking.sliding(pages, 5, 0), lambda: chunking.sliding(pages, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_chunk_numbers_follow_order(spark):
    rng = random.Random(2)
    rows = [("c" if i % 3 else "d", f"file-{rng.randint(0, 30):02d}", p, "TITRE UN\n" + "a b c d e " * rng.randint(0, 6) + "\nTITRE DEUX\nz, z.") for i, p in enumerate(list(range(1, 60)))]
    cut = chunking.structure(spark.createDataFrame(rows, PAGES), 7, 2)
    want = {}
    for r in sorted(cut.collect(), key=lambda r: (r["collection_id"], r["source_file"], r["page"], r["segment_ord"], r["window_ord"])):
        want.setdefault(r["collection_id"], []).append((r["source_file"], r["page"], r["start"], r["section_title"], r["text"]))
    for c, own in want.items():
        got = chunking.numbered(cut).where(F.col("collection_id") == c).orderBy("chunk_ord").collect()
        assert [r["chunk_ord"] for r in got] == list(range(len(own)))
        assert [(r["source_file"], r["page"], r["start"], r["section_title"], r["text"]) for r in got] == own


def tfidf(texts, question, stop):
    terms = [Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop) for t in texts]
    df = Counter(w for t in terms for w in t)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(c):
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        s = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / s for w, x in v.items()}

    q = unit(Counter(w for w in re.findall(r"\w{2,}", question.lower()) if w not in stop))
    return [round(sum(x * q.get(w, 0) for w, x in unit(t).items()), 6) for t in terms]


def test_sparse_retrieval(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "x", "mu"]) for _ in range(8)) for _ in range(30)]
    chunks = chunking.numbered(chunking.fixed(pages_of(spark, texts)))
    questions = ["alpha of beta", "unknown words", "the of", "gamma gamma delta mu"]
    asked = spark.createDataFrame(list(enumerate(questions)), "question_idx int, question string")
    stop = T.english_stop_words()
    assert len(stop) == 318
    for k in (0, 4, 100):
        rows = search(chunks, asked, k).collect()
        for i, q in enumerate(questions):
            scores = tfidf(texts, q, stop)
            want = sorted(range(30), key=lambda d: (-scores[d], d))[:k]
            own = sorted((r for r in rows if r["question_idx"] == i), key=lambda r: r["rank"])
            assert [r["chunk_ord"] for r in own] == want and [r["score"] for r in own] == pytest.approx([scores[d] for d in want])
    with pytest.raises(ValueError):
        search(chunks, asked, -1)
    with pytest.raises(ValueError):
        sparse.require_terms(chunks.limit(0).select(F.lit("x").alias("term")))


def test_dense_retrieval(spark):
    rows = [("c", "semantic", i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], [1.0, 1.0], None])]
    vectors = spark.createDataFrame(rows, "collection_id string, pipeline string, chunk_ord int, embedding array<float>").withColumn("norm", dense.norm(F.col("embedding")))
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "question_idx int, vector array<float>").withColumn("vector_norm", dense.norm(F.col("vector")))
    assert [(r["chunk_ord"], r["score"]) for r in dense.retrieve_vectors(vectors, asked, 4).orderBy("rank").collect()] == [(0, 1.0), (2, pytest.approx(0.707107)), (1, 0.0), (3, 0.0)]
    longer = asked.withColumn("vector", F.array(*[F.lit(1.0).cast("float")] * 3))
    with pytest.raises(Exception, match="unequal"):
        dense.retrieve_vectors(vectors, longer, 4).collect()


class Failing:
    def open(self):
        pass

    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0] for _ in texts]


def test_embedding_failures(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in dense.embed(rows, "t", Failing()).collect()}
    assert got == {1: [1.0, 2.0], 2: None, 3: [1.0, 2.0]}
    with pytest.raises(Exception, match="no"):
        dense.embed(rows, "t", Failing(), tolerant=False).collect()


def test_extractive_answers(spark):
    rows = [(0, "red fox", ["A dog. A red fox!  The fox.", "Red. Blue."]), (1, "x", []), (2, "x", [" ", "\n"]), (3, "zz", ["One. Two. Three. Four. Five."])]
    df = spark.createDataFrame(rows, "i int, q string, p array<string>")
    got = [r[0] for r in df.orderBy("i").select(answers.extractive_answer(F.col("q"), F.col("p"), 4)).collect()]
    assert got == ["A red fox! The fox. Red. A dog.", "", " ", "One. Two. Three. Four."]


def test_jaccard_and_formats(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), (None, "a"), ("Été x", "x été")], "a string, b string")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0, 0.0, 1.0]
    nums = spark.createDataFrame([("1.25",), ("nan",), ("x",), (None,)], "v string")
    assert [(r[0], r[1]) for r in nums.select(T.finite(F.col("v")), T.three_decimals(T.finite(F.col("v")))).collect()] == [(1.25, "1.250"), (None, "N/A"), (None, "N/A"), (None, "N/A")]
    assert one(spark, ["a" * 151, "b"], T.preview) == ["a" * 150 + "...", "b"]


def test_metrics(spark):
    rows = [(0, "p", "q", "a", ["c"]), (1, "p", "q", " ", ["c"]), (2, "p", "q", "a", []), (3, "p", "q", "a", ["c", " "]), (4, "r", "q", None, ["c"]), (5, "p", "c q", "q", ["c"])]
    own = spark.createDataFrame(rows, "question_idx int, pipeline string, question string, answer string, contexts array<string>")
    truths = spark.createDataFrame([(i, "q") for i in range(6)], "question_idx int, truth string")
    d = {r["pipeline"]: (r["entries"], r["empty_contexts"], r["empty_answers"], r["valid"]) for r in evaluation.diagnostics(own).collect()}
    assert d == {"p": (5, 1, 1, 2), "r": (1, 0, 1, 0)}
    long = evaluation.metric_rows(evaluation.judged(own, truths, providers.OverlapJudge()))
    assert {r["question_idx"] for r in long.where("value is not null").collect()} == {0, 5} and long.count() == 24
    summary = {r["pipeline"]: r for r in evaluation.metric_summary(long).collect()}
    assert set(summary) == {"p", "r"} and summary["r"]["answer_relevancy"] is None
    summary = summary["p"]
    assert summary["answer_relevancy"] == pytest.approx(0.25) and summary["context_recall"] == 0.0
    assert evaluation.overall(evaluation.metric_summary(long.withColumn("value", F.lit(None).cast("double")))).collect()[0]["average"] is None
    report = {r["pipeline"]: r["proxy_similarity_mean"] for r in evaluation.proxy_report(own, truths.limit(0)).collect()}
    assert report == {"p": 0.0, "r": 0.0}


@pytest.mark.parametrize(("reply", "want"), [
    ('{"question": " a ", "answer": "b"}', ("a", "b")), ('Sure: {"question": "a",\n"answer": "b"} bye', ("a", "b")), ('{"question": "a", "answer": "b"} tail', None),
    ("none", None), ('{"question": "a"}', None), ('{"question": 1, "answer": "b"}', None), ("[1]", None), (None, None), ("} {", None),
])
def test_reply_parsing(reply, want):
    assert groundtruth.parse_reply(reply) == want


def test_ground_truth(spark):
    pages = pages_of(spark, ["word " * n for n in (10, 60, 100, 900)])
    model = providers.ScriptedModel(lambda p: '{"question": "q", "answer": "é"}' if "f001" in p else "nothing")
    rows = generate_ground_truth(pages, model).collect()
    assert [r.asDict() for r in rows] == [{"question": "q", "answer": "é", "source_document": "f001", "page": 1, "doc_section": "", "chunk_id": "", "generated_by": "scripted:1"}]
    cut = groundtruth.candidates(chunking.ground_truth_windows(pages, 20, 0), 50, 100)
    a, b = (sorted(map(tuple, groundtruth.sample(cut, 3, s).select("source_file", "start").collect())) for s in (1, 1))
    assert a == b and max(Counter(f for f, _ in a).values()) == 3


def test_scan(spark, tmp_path):
    files = {"b.txt": "é\r\nx\ry".encode() + b"\xff", "a.MD": b"upper", "c.md": b"# t", "d.pdf": b"%PDF", "e.csv": b"no", "un été+1.txt": b"z"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_bytes(b"deep")
    with pytest.raises(ValueError, match=r"d\.pdf"):
        readers.pages(spark, str(tmp_path), "c")
    own = {r["source_file"]: r["text"] for r in readers.pages(spark, str(tmp_path), "c", skip_pdf=True).collect()}
    assert own == {"b.txt": "é\nx\ny", "c.md": "# t", "un été+1.txt": "z"}
    pdf = lambda data: ["one", None]
    assert {(r["page"], r["text"]) for r in readers.pages(spark, str(tmp_path), "c", pdf).where("source_file = 'd.pdf'").collect()} == {(1, "one"), (2, "")}
    single = readers.pages(spark, str(tmp_path / "e.csv"), "c", folder=False).collect()
    assert [(r["source_file"], r["text"]) for r in single] == [(None, "no")]
    with pytest.raises(ValueError):
        readers.require_pages(readers.pages(spark, str(tmp_path / "sub"), "c").limit(0))


def test_questions(spark, tmp_path):
    path = tmp_path / "gt.jsonl"
    path.write_text('{"question": "a", "answer": "b", "page": 1}\n\n  \n{"question": "c", "answer": "d"}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.numbered_questions(spark, str(path)).collect()] == [(0, "a", "b"), (1, "c", "d")]
    path.write_text("{oops\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.ground_truth(spark, str(path)).collect()


TEXTS = {"a.txt": "TITRE UN\nThe fox jumps over the lazy dog, again.\nTITRE DEUX\nA cat sleeps all day, quietly.", "b.txt": "Rivers run to the sea. The sea is deep."}


def test_engine_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in TEXTS.items():
        (folder / name).write_text(text, encoding="utf-8")
    own = Engine(spark, str(tmp_path / "data"), embedders={"semantic": providers.HashEmbedder(), "azure_semantic": Failing()})
    status = {r["pipeline"]: r["chunks"] for r in own.ingest(str(folder), "animals").collect()}
    assert status == {"fixed": 2, "sliding": 2, "structure": 3, "semantic": 2, "azure_semantic": 2}
    assert own.ingest(str(folder), "animals").count() == 5 and readers.chunk_store(spark, own.data, "animals").count() == 11
    found = own.ask_json("Where does the cat sleep?", "animals")
    assert [r["pipeline"] for r in found["results"]] == sorted(CLASSIC)
    top = next(r for r in found["results"] if r["pipeline"] == "structure")["sources"][0]
    assert (top["section_title"], top["source_file"]) == ("TITRE DEUX", "a.txt") and len(next(iter(found["results"]))["sources"]) == 2
    assert own.ask_json("deep sea", "animals", pipelines=("semantic",))["results"][0]["sources"][0]["source_file"] == "b.txt"
    chat = own.chat("sea?", "animals", providers.ScriptedModel(lambda p: p.split("\n")[2]), "fixed")
    assert chat["answer"].startswith("[Source 1: b.txt - Page 1]") and chat["error"] is None and re.fullmatch(r"\d\.\d{3}", chat["sources"][0]["score"])
    broken = own.chat("sea?", "animals", providers.ScriptedModel(lambda p: 1 / 0), "fixed")
    assert broken["answer"] is None and "division" in broken["error"]
    with pytest.raises(FileNotFoundError):
        own.ask_json("x", "nobody")
    questions = spark.createDataFrame([(0, "Where do rivers run?", "to the sea"), (1, "What does the fox do?", "jumps")], "question_idx int, question string, truth string")
    written = own.evaluate(questions, "animals", judge=providers.OverlapJudge(), use_llm=True, model=providers.ScriptedModel(lambda p: "to the sea"))
    assert all(written[f"{p}_proxy"]["proxy_similarity_mean"] == 0.5 for p in CLASSIC)
    with pytest.warns(UserWarning, match="no embedder"):
        assert Engine(spark, own.data).ask(questions, "animals", pipelines=("fixed", "semantic")).count() == 2
    report = own.evaluate(questions, "animals", judge=providers.OverlapJudge(), use_llm=True, export=str(tmp_path / "out"))
    assert {f"{p}_proxy" for p in CLASSIC} <= set(report) and set(report["summary"]) == set(CLASSIC)
    rows = list(csv.reader(open(glob.glob(str(tmp_path / "out/ragas_summary.csv/*.csv"))[0], encoding="utf-8")))
    assert rows[0] == ["pipeline", "answer_relevancy", "faithfulness", "context_precision", "context_recall"] and len(rows) == 4
    assert "warning" in own.evaluate(questions, "animals", judge=providers.OverlapJudge(), local_proxy=False)
    told = own.ask(questions, "animals", model=providers.ScriptedModel(lambda p: 1 / 0)).collect()
    assert all(r["answer"].startswith("The model could not answer") and r["error"] for r in told)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, text in TEXTS.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    data = ["--data", str(tmp_path / "d")]
    assert cli.main([*data, "ingest", "--doc", str(tmp_path / "in"), "--doc-id", "c"], spark) == 0
    capsys.readouterr()
    assert cli.main([*data, "ask", "--doc-id", "c", "--question", "fox"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3
    assert cli.main([*data, "ask", "--doc-id", "nobody", "--question", "fox"], spark) == 1
    assert cli.main(["--data", str(tmp_path / "none"), "ask", "--doc-id", "c", "--question", "fox"], spark) == 1
    assert cli.main([*data, "ingest", "--doc", str(tmp_path / "missing"), "--doc-id", "c"], spark) == 1


def test_http(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in TEXTS.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    own = Engine(spark, str(tmp_path / "d"))
    own.ingest(str(tmp_path / "in"), "c")
    served = api.server(own, port=0)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{served.server_port}"
    got = json.load(urllib.request.urlopen(f"{base}/ask?doc_id=c&question=deep%20sea&top_k=1"))
    assert got["question"] == "deep sea" and [len(r["sources"]) for r in got["results"]] == [1, 1, 1]
    for path, status in (("/ask?doc_id=x&question=y", 404), ("/ask?doc_id=c", 422), ("/ask?doc_id=c&question=y&top_k=-1", 422), ("/", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == status
    served.shutdown()


def test_providers():
    with pytest.raises(ValueError):
        providers.language_model("other")
    with pytest.raises(ValueError):
        providers.language_model("azure")
    assert providers.language_model("azure", client=lambda m, n: " x ").generate("p") == "x"
    assert CloudSettings("k", "e", "", "").missing() == ["deployment", "embedding_deployment"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, text in enumerate(TEXTS.values()):
        (tmp_path / "in" / f"{k}.txt").write_text(text, encoding="utf-8")
        stream.write_chunks(stream.page_stream(spark, str(tmp_path / "in"), "c"), out, state).awaitTermination()
    assert spark.read.parquet(out).groupBy("pipeline").count().count() == 3 and spark.read.parquet(out).count() == 7


def test_json_lines_and_top_k(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é"), (2, "b", "c")], "question_idx int, a string, b string")
    writers.json_lines(df, str(tmp_path / "x"))
    lines = [json.loads(x) for f in glob.glob(str(tmp_path / "x/*.json")) for x in open(f, encoding="utf-8")]
    assert {"question_idx": 1, "a": None, "b": "é"} in lines
    tied = spark.createDataFrame([(0, 1.0, 2), (0, 1.0, 1), (0, 2.0, 3)], "g int, score double, chunk_ord int")
    assert [r["chunk_ord"] for r in top_k(tied, ["g"], 2).orderBy("rank").collect()] == [3, 1]


def test_plans_stay_in_the_jvm(spark, sf):
    from passage_engine.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    cut, found = plan("chunk_structure"), plan("retrieve_tfidf_structure")
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in cut and "WindowGroupLimit" in found
    assert not any("Python" in x or "Pandas" in x or "Arrow" in x for x in (cut, found))


def test_dense_search_asks_every_hundredth_vector(spark, sf):
    import numpy as np

    from passage_engine.operators import dense
    from passage_engine.queries import QUERIES

    own = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in own]), np.array([r[1] for r in own], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.round(m @ m[i], 6)
        want |= {(int(ids[i]), rank + 1, int(ids[j])) for rank, j in enumerate(np.lexsort((ids, -score))[:6])}
    found = QUERIES["retrieve_dense_cosine"](spark, sf).collect()
    assert len(found) == len(want) and {(r["question_idx"], r["rank"], r["chunk_ord"]) for r in found} == want
    vectors = spark.createDataFrame([("c", "p", k, [float(k), 1.0], (k * k + 1.0) ** 0.5) for k in range(9)], "collection_id string, pipeline string, chunk_ord int, embedding array<float>, norm double")
    asked = vectors.select(F.col("chunk_ord").alias("question_idx"), F.col("embedding").alias("vector"), F.col("norm").alias("vector_norm"))
    assert sorted(map(tuple, dense.retrieve_in_blocks(vectors, asked, 3, 2).collect())) == sorted(map(tuple, dense.retrieve_vectors(vectors, asked, 3).collect()))


def test_zero_fill_asks_every_question(spark, sf):
    from passage_engine.queries import QUERIES

    items = {r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    found = QUERIES["retrieve_zero_fill"](spark, sf).select("question_idx").distinct().collect()
    assert {r[0] for r in found} == items | {-1}


def test_ingest_indexes_every_collection(spark, tmp_path, monkeypatch):
    """A cap on the collections, however large, is met here by two."""
    pages = spark.createDataFrame([(c, "f", 1, f"The {c} sleeps under warm blankets.") for c in ("cat", "dog", "owl")], "collection_id string, source_file string, page int, text string")
    whole = type(pages).limit
    monkeypatch.setattr(type(pages), "limit", lambda self, n: whole(self, min(n, 2)))
    own = Engine(spark, str(tmp_path / "data"))
    assert {r["collection_id"] for r in own.ingest_pages(pages).collect()} == {"cat", "dog", "owl"}
    for name in ("term_stats", "postings"):
        assert {r[0] for r in spark.read.parquet(f"{own.data}/{name}").select("collection_id").distinct().collect()} == {"cat", "dog", "owl"}


def test_numbering_over_ranges_of_names(spark, monkeypatch):
    from passage_engine.operators import chunking

    rows = [("c" if i % 3 else "d", f"doc{i:03d}" + "é" * (i % 2), 1, " ".join(["w"] * (i % 7 * 3))) for i in range(60)]
    cut = chunking.fixed(spark.createDataFrame(rows, "collection_id string, source_file string, page int, text string"), 5, 1)
    plain = sorted(map(tuple, chunking.numbered(cut).collect()))
    monkeypatch.setattr(chunking, "RUNS", 4)
    assert sorted(map(tuple, chunking.numbered(cut).collect())) == plain
    own = [r for r in plain if r[0] == "c"]
    assert [r[2] for r in own] == list(range(len(own))) and [r[3] for r in own] == sorted(r[3] for r in own)


def test_terms_are_counted_in_their_row(spark, strings):
    """No term is dealt: one row a text goes in, its counted terms come out."""
    want = [Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w not in T.english_stop_words()) for t in strings]
    got = one(spark, strings, T.term_counts)
    assert [{x["term"]: x["tf"] for x in r or []} for r in got] == want and all(len(r or []) == len(w) for r, w in zip(got, want))
    chunks = chunking.numbered(chunking.fixed(pages_of(spark, ["b a bb aa bb"])))
    plan = sparse.term_frequency(chunks.select("collection_id", "pipeline", "chunk_ord", "text").coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Generate")[0]


def test_blocks_of_any_size(spark, monkeypatch):
    """Repeated pages, collections without a name and blocks of a few bytes leave numbers, scores and texts as they are."""
    from passage_engine.operators import blocks

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "mu", "Section 1\n", "\nTITRE UN\n"]
    rows = [("c" if i % 3 else "d", f"f{i % 40:02d}", 1 + i % 2, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(90)]
    pages = spark.createDataFrame([*rows, rows[5], (None, "x", 1, "alpha beta")], PAGES)
    asked = spark.createDataFrame(list(enumerate(["alpha of beta", "unknown words", "gamma gamma delta mu"])), "question_idx int, question string")
    cuts = chunking.Cut("fixed", 7, 5), chunking.Cut("structure", 5, 3, True)

    def results():
        numbers = blocks.numbered(pages, cuts).collect()
        passages = answers.with_passages(search(chunking_table, asked, 4), chunking_table) if chunking_table else blocks.retrieve_passages(pages, cuts, asked, 4)
        return sorted(map(str, numbers)), sorted(map(str, (r.asDict() for r in passages.select("question_idx", "collection_id", "pipeline", "rank", "score", "chunk_ord", "text", "meta").collect() if r["collection_id"])))

    chunking_table = None
    whole = results()
    for size in (1 << 12, 200):
        monkeypatch.setattr(blocks, "BLOCK", size)
        assert blocks.deal(pages, cuts).blocks.count() > 3 or size > 200
        assert results() == whole
    chunking_table = blocks.numbered(pages, cuts).cache()
    assert results()[1] == whole[1]
    ords = {}
    for r in sorted(chunking_table.collect(), key=lambda r: (str(r[0]), r[1], r[2])):
        ords.setdefault((r[0], r[1]), []).append((r["chunk_ord"], r["source_file"], r["page"]))
    assert all([x[0] for x in v] == list(range(len(v))) and [x[1:] for x in v] == sorted(x[1:] for x in v) for v in ords.values())


def test_postings_stay_in_their_block(spark, sf, monkeypatch):
    """What is dealt between tasks has a row a page, a row a term of a block, or k rows a question: no plan deals rows by chunk."""
    from passage_engine.queries import QUERIES
    from passage_engine.sources import tables

    plans, pin = [], tables.pin
    monkeypatch.setattr(tables, "pin", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df, name))
    for name in ("retrieve_tfidf_fixed", "answer_payload_sources", "postings", "chunk_norms", "chunk_counts_by_pipeline"):
        found = QUERIES[name](spark, sf)
        plans.append(found._jdf.queryExecution().executedPlan().toString().replace("keys=[question_idx", ""))
    dealt = [x for p in plans for x in re.findall(r"Exchange hashpartitioning\((.*)\), \w", p)]
    assert dealt and not [x for x in dealt if re.search(r"\bnth#|tf#", x) or "chunk_ord#" in x and "question_idx#" not in x]
    assert "Expand" not in plans[-1]


def test_ground_truth_is_written_by_many_tasks(spark, tmp_path):
    writers.json_lines(spark.range(40).repartition(4).select(F.col("id").cast("string").alias("question"), F.lit(None).cast("string").alias("answer")), str(tmp_path / "x"))
    assert len(glob.glob(str(tmp_path / "x/*.json"))) == 4 and readers.ground_truth(spark, str(tmp_path / "x")).count() == 40


def test_dense_search_makes_no_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (70, 3)).astype(float)
    rows = [("c" if i % 2 else None, "p", i, None if i == 9 else [float(x) for x in v]) for i, v in enumerate(m)]
    m[9] = 0
    vectors = spark.createDataFrame(rows, "collection_id string, pipeline string, chunk_ord int, embedding array<float>").withColumn("norm", dense.norm(F.col("embedding"))).repartition(3)
    asked = vectors.where("chunk_ord in (1, 2, 9)").select(F.col("chunk_ord").alias("question_idx"), F.col("embedding").alias("vector"), F.col("norm").alias("vector_norm"))
    monkeypatch.setattr(dense, "HELD", 12)
    found = dense.retrieve_vectors(vectors, asked, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    want = set()
    for q in (1, 2, 9):
        score = np.round(unit @ unit[q], 6) + 0.0
        for odd in (0, 1):
            own = np.arange(odd, 70, 2)
            want |= {(q, "c" if odd else None, rank + 1, int(own[j])) for rank, j in enumerate(np.lexsort((own, -score[own]))[:4])}
    assert {(r["question_idx"], r["collection_id"], r["rank"], r["chunk_ord"]) for r in found.collect()} == want
