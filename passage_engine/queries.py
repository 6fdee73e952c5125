"""The engine's operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

``documents`` are one-page files: a source is a collection, a doc_id a file. ``benchmark`` has the questions,
``conversations`` pairs of a user turn and the assistant's next, ``embeddings`` the vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine.config import DEFAULTS as D
from passage_engine.functions import text as T
from passage_engine.operators import answers, blocks, chunking, dense, evaluation, groundtruth, sparse
from passage_engine.operators.topk import top_k
from passage_engine.plans import engine
from passage_engine.providers import HashEmbedder, OverlapJudge, ScriptedModel
from passage_engine.sources import readers, tables, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIPELINES = ("fixed", "structure", "sliding")
TASK_BYTES = 16 << 20  # of texts that one task sorts or groups
CUTS = {c.pipeline: c for c in chunking.classic()}
FIXED_CUT, SEMANTIC = (CUTS["fixed"],), chunking.Cut("semantic", D.fixed_size, D.fixed_size - D.fixed_overlap)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- inputs


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("source_file"), F.lit(1).alias("page"), "text")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("question_idx"), F.col("text").alias("question"))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as their texts need, where the session's number of tasks is too small for that."""
    texts = [F.octet_length(f.name) for f in rows.schema.fields if f.dataType.typeName() == "string"]
    total = rows.agg(F.coalesce(F.sum(sum(map(lambda x: F.coalesce(x, F.lit(0)), texts), F.lit(0))), F.lit(0))).first()[0]
    n = total // TASK_BYTES
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's next turn; the conversation's first user turn is the truth."""
    c = _table(spark, sf, "conversations")
    user, reply = c.where("role = 'user'"), c.where("role = 'assistant'").select(F.col("conv_id").alias("cid"), (F.col("turn") - 1).alias("before"), F.col("text").alias("answer"))
    return user.join(reply, (F.col("conv_id") == F.col("cid")) & (F.col("turn") == F.col("before"))).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def _index(spark: SparkSession, sf: str) -> blocks.Index:
    return blocks.index(blocks.deal(_pages(spark, sf), FIXED_CUT))


def _of_chunks(rows: DataFrame, own: blocks.Index) -> DataFrame:
    named = blocks.named(rows, own.dealt, FIXED_CUT)
    return named.withColumn("chunk_ord", (F.col("before") + F.col("nth")).cast("int"))


# ---------------------------------------------------------------- SQL parts

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WS = r"[^\s\x{1c}-\x{1f}\x{0b}\x{85}\p{Z}]"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|{NOT_WS}"
CASED = r"A-Z\x{130}\x{131}\x{17f}\x{212a}"
HEADING = rf"(?im)^({WS}*(?:Art[iıİ]cle{WS}+\p{{Nd}}+|[sſ]ect[iıİ]on{WS}+\p{{Nd}}+|Chap[iıİ]tre{WS}+\p{{Nd}}+|[{CASED}][{CASED}0-9 \-]{{4,}})){WS}*$"
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(T.english_stop_words())) + "]"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def _join(x: str) -> str:
    return rf"regexp_replace(array_to_string({x}, ' '), ' ?([^\p{{L}}\p{{N}}_ ]) ?', '\1', 'g')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def _terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOP}, t))"


def _set(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({_set(a)}) > 0 AND len({_set(b)}) > 0 THEN len(list_intersect({_set(a)}, {_set(b)}))::DOUBLE / len(list_distinct(list_concat({_set(a)}, {_set(b)}))) ELSE 0.0 END"


PAGES = "pages_ AS (SELECT source AS collection_id, doc_id::VARCHAR AS source_file, 1 AS page, text FROM documents)"
SEGMENTS = f"""bodies AS (SELECT *, regexp_extract_all(text, '{HEADING}', 1) AS titles, regexp_split_to_array(text, '{HEADING}') AS parts FROM pages_),
segs AS (
  SELECT collection_id, source_file, page, 0 AS segment_ord, NULL::VARCHAR AS section_title, text AS body FROM bodies WHERE len(titles) = 0
  UNION ALL SELECT collection_id, source_file, page, i - 1, {_strip("titles[i]")}, parts[i + 1] FROM (SELECT *, unnest(range(1, len(titles) + 1)) AS i FROM bodies WHERE len(titles) > 0))"""


def _cut(rows: str, pipeline: str, size: int, step: int) -> str:
    return f"""(SELECT collection_id, '{pipeline}' AS pipeline, source_file, page, segment_ord, k AS window_ord, k * {step} AS start, least(k * {step} + {size}, len(tk)) AS "end", section_title,
    {_join(f"tk[k * {step} + 1 : least(k * {step} + {size}, len(tk))]")} AS text
  FROM (SELECT *, unnest(range(least(greatest(ceil((len(tk) - {size}) / {step}::DOUBLE), 0) + 1, ceil(len(tk) / {step}::DOUBLE))::BIGINT)) AS k
    FROM (SELECT *, {_tokens("body")} AS tk FROM {rows}) WHERE len(tk) > 0))"""


WHOLE = "(SELECT collection_id, source_file, page, 0 AS segment_ord, NULL::VARCHAR AS section_title, text AS body FROM pages_)"
NUMBERED = 'SELECT collection_id, pipeline, (row_number() OVER (PARTITION BY collection_id, pipeline ORDER BY source_file, page, segment_ord, window_ord) - 1)::INT AS chunk_ord, source_file, page, start, "end", section_title, text FROM cut'
_PARTS = {"fixed": _cut(WHOLE, "fixed", 500, 420), "structure": _cut("segs", "structure", 500, 420), "sliding": _cut(WHOLE, "sliding", 400, 200)}


def _chunk_sql(*pipelines: str) -> str:
    return f"{PAGES}, {SEGMENTS}, cut AS ({' UNION ALL '.join('SELECT * FROM ' + _PARTS[p] for p in pipelines)}), chunks AS MATERIALIZED ({NUMBERED})"


ALL, FIXED = _chunk_sql(*PIPELINES), _chunk_sql("fixed")
SHOWN = 'collection_id, pipeline, chunk_ord, source_file, page::INT AS page, start::INT AS start, "end"::INT AS "end", section_title, md5(text) AS text_md5'
INDEX = f"""tf AS (SELECT collection_id, pipeline, chunk_ord, term, count(*) AS tf FROM (SELECT collection_id, pipeline, chunk_ord, unnest({_terms("text")}) AS term FROM chunks) GROUP BY ALL),
stats AS (SELECT collection_id, pipeline, term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT collection_id, pipeline, term, count(*) AS df FROM tf GROUP BY ALL) JOIN (SELECT collection_id, pipeline, count(*) AS n FROM chunks GROUP BY ALL) USING (collection_id, pipeline)),
post AS (SELECT collection_id, pipeline, chunk_ord, term, tf, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY collection_id, pipeline, chunk_ord)) AS weight FROM tf JOIN stats USING (collection_id, pipeline, term))"""


def _search(questions: str, k: int) -> str:
    return f"""qs AS ({questions}),
qt AS (SELECT question_idx, term, count(*) AS tf FROM (SELECT question_idx, unnest({_terms("question")}) AS term FROM qs) GROUP BY ALL),
qv AS (SELECT collection_id, pipeline, question_idx, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY collection_id, pipeline, question_idx)) AS q FROM qt JOIN stats USING (term)),
dots AS (SELECT question_idx, collection_id, pipeline, chunk_ord, sum(weight * q) AS s FROM post JOIN qv USING (collection_id, pipeline, term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT q.question_idx, c.collection_id, c.pipeline, c.chunk_ord, coalesce(round(s, 6), 0) AS score,
    row_number() OVER (PARTITION BY q.question_idx, c.collection_id, c.pipeline ORDER BY coalesce(round(s, 6), 0) DESC, c.chunk_ord)::INT AS rank
  FROM chunks c CROSS JOIN qs q LEFT JOIN dots d ON d.question_idx = q.question_idx AND d.collection_id = c.collection_id AND d.pipeline = c.pipeline AND d.chunk_ord = c.chunk_ord) WHERE rank <= {k})"""


BENCH = "SELECT item_id::INT AS question_idx, text AS question FROM benchmark"
PAIRS = "qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
HITS = "question_idx, collection_id, pipeline, rank, score, chunk_ord"


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text_md5", F.md5("text")).drop("text")


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, len({_tokens('text')})::INT AS n_tokens, len(list_distinct({_tokens('text')}))::INT AS n_distinct FROM documents")
def tokenize_stats(spark, sf):
    own = _table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT doc_id, md5({_join(_tokens('text'))}) AS joined_md5 FROM documents")
def detokenize(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(T.join_tokens(T.tokens(F.col("text")))).alias("joined_md5"))


@query(f"SELECT doc_id, i::INT AS heading_ord, {_strip('h[i]')} AS title FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{HEADING}', 1) AS h FROM documents))")
def headings(spark, sf):
    own = _table(spark, sf, "documents").select("doc_id", F.posexplode(T.heading_titles(F.col("text"))).alias("i", "title"))
    return own.select("doc_id", (F.col("i") + 1).alias("heading_ord"), "title")


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[.!?]{WS}+'))::INT + 1 AS raw_sentences, len(regexp_extract_all({_join(_tokens('text'))}, '[.!?]{WS}+'))::INT + 1 AS joined_sentences FROM documents")
def sentence_split(spark, sf):
    joined = T.join_tokens(T.tokens(F.col("text")))
    return _table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("raw_sentences"), F.size(T.sentences(joined)).alias("joined_sentences"))


@query(f"SELECT page_id, url, element_at(string_split(url, '/'), -1) AS name, lower(regexp_extract(url, '.(\\.[^./]*)$', 1)) AS ext, left(html, 300) AS snippet, CASE WHEN length(html) > 150 THEN left(html, 150) || '...' ELSE html END AS preview FROM pages".replace("element_at(string_split(url, '/'), -1)", "string_split(url, '/')[-1]"))
def projections(spark, sf):
    return _table(spark, sf, "pages").select("page_id", "url", T.file_name(F.col("url")).alias("name"), T.extension(F.col("url")).alias("ext"), T.prefix(F.col("html"), 300).alias("snippet"), T.preview(F.col("html")).alias("preview"))


# ---------------------------------------------------------------- chunks


@query(f"WITH {FIXED} SELECT {SHOWN} FROM chunks")
def chunk_fixed(spark, sf):
    return _shown(blocks.numbered(_pages(spark, sf), FIXED_CUT))


@query(f"WITH {_chunk_sql('sliding')} SELECT {SHOWN} FROM chunks")
def chunk_sliding(spark, sf):
    return _shown(blocks.numbered(_pages(spark, sf), (CUTS["sliding"],)))


@query(f"WITH {PAGES}, {SEGMENTS}, cut AS (SELECT * FROM {_cut(WHOLE, 'sliding', 100, 150)}), chunks AS ({NUMBERED}) SELECT {SHOWN} FROM chunks")
def chunk_sliding_gapped(spark, sf):
    return _shown(blocks.numbered(_pages(spark, sf), (chunking.Cut("sliding", 100, 150),)))


@query(f"WITH {_chunk_sql('structure')} SELECT {SHOWN} FROM chunks")
def chunk_structure(spark, sf):
    return _shown(blocks.numbered(_pages(spark, sf), (CUTS["structure"],)))


@query(f"WITH {PAGES}, {SEGMENTS}, cut AS (SELECT * FROM {_cut(WHOLE, 'semantic', 500, 420)}), chunks AS ({NUMBERED}) SELECT {SHOWN} FROM chunks")
def chunk_semantic(spark, sf):
    return _shown(blocks.numbered(_pages(spark, sf), (SEMANTIC,)))


@query(f"WITH {ALL} SELECT {SHOWN} FROM chunks")
def union_pipelines(spark, sf):
    return _shown(engine.build_chunks(_pages(spark, sf)))


@query(f"WITH {ALL} SELECT collection_id, pipeline, count(*) AS chunks, count(DISTINCT (source_file, page)) AS pages, count(DISTINCT source_file) AS files FROM chunks GROUP BY ALL")
def chunk_counts_by_pipeline(spark, sf):
    return evaluation.status(chunking.all_classic(_pages(spark, sf)))


# ---------------------------------------------------------------- sparse index


@query(f"WITH {FIXED}, {INDEX} SELECT * FROM tf")
def term_frequency(spark, sf):
    return sparse.term_frequency(blocks.numbered(_pages(spark, sf), FIXED_CUT))


@query(f"WITH {FIXED}, {INDEX} SELECT collection_id, pipeline, term, df, round(idf, 6) AS idf FROM stats")
def term_stats_idf(spark, sf):
    own = _index(spark, sf)
    return blocks.named(own.term_stats(), own.dealt, FIXED_CUT).select("collection_id", "pipeline", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {FIXED}, {INDEX} SELECT collection_id, pipeline, chunk_ord, round(sqrt(sum((tf * idf) ** 2)), 6) AS norm FROM tf JOIN stats USING (collection_id, pipeline, term) GROUP BY ALL")
def chunk_norms(spark, sf):
    own = _index(blocks.session(spark), sf)
    return _of_chunks(own.norms(), own).select("collection_id", "pipeline", "chunk_ord", F.round("norm", 6).alias("norm"))


@query(f"WITH {FIXED}, {INDEX} SELECT collection_id, pipeline, chunk_ord, term, tf, round(weight, 6) AS weight FROM post")
def postings(spark, sf):
    own = _index(blocks.session(spark), sf)
    return _of_chunks(own.postings(), own).select("collection_id", "pipeline", "chunk_ord", "term", "tf", F.round("weight", 6).alias("weight"))


@query(f"WITH {FIXED}, {INDEX} SELECT collection_id, pipeline, count(DISTINCT term) AS vocabulary FROM stats GROUP BY ALL")
def vocabulary(spark, sf):
    own = _index(spark, sf)
    return blocks.named(own.term_stats(), own.dealt, FIXED_CUT).groupBy("collection_id", "pipeline").agg(F.count("*").alias("vocabulary"))


def _retrieval(name: str) -> None:
    def run(spark, sf):
        return blocks.retrieve(_pages(spark, sf), (CUTS[name],), _questions(spark, sf), D.top_k)

    run.__name__ = f"retrieve_tfidf_{name}"
    query(f"WITH {_chunk_sql(name)}, {INDEX}, {_search(BENCH, 6)} SELECT {HITS} FROM hits")(run)


for _name in PIPELINES:
    _retrieval(_name)


@query(f"WITH {FIXED}, {INDEX}, {_search(BENCH + ''' UNION ALL SELECT -1, 'zzqqx unknownish the of and'  ''', 9)} SELECT {HITS} FROM hits")
def retrieve_zero_fill(spark, sf):
    """All questions and one without a known term, whose number no question has; k beyond a collection's matches."""
    unknown = spark.createDataFrame([(-1, "zzqqx unknownish the of and")], "question_idx int, question string")
    return blocks.retrieve(_pages(spark, sf), FIXED_CUT, _questions(spark, sf).unionByName(unknown), 9)


# ---------------------------------------------------------------- sinks and scans


@query(f"WITH {ALL} SELECT {SHOWN} FROM chunks")
def chunk_store_round_trip(spark, sf):
    """Chunks of all pipelines written into the partitioned store and scanned again."""
    data = tables.new_path(spark, "index")
    writers.store_dealt(blocks.numbered(_pages(spark, sf), chunking.classic()), data, "chunks", ["chunk_ord"])
    return _shown(readers.chunk_store(spark, data)).select("collection_id", "pipeline", "chunk_ord", "source_file", "page", "start", "end", "section_title", "text_md5")


@query(f"WITH {FIXED}, {INDEX} SELECT collection_id, pipeline, chunk_ord, term, tf, round(weight, 6) AS weight, df, round(idf, 6) AS idf FROM post JOIN stats USING (collection_id, pipeline, term)")
def sparse_index_round_trip(spark, sf):
    """Postings and term statistics written into the store, scanned again and joined."""
    data, own = tables.new_path(spark, "index"), _index(blocks.session(spark), sf)
    writers.store_dealt(blocks.named(own.term_stats(), own.dealt, FIXED_CUT).select("collection_id", "pipeline", "term", "df", "idf"), data, "term_stats", ["term"])
    writers.store_dealt(_of_chunks(own.postings(), own).select("collection_id", "pipeline", "chunk_ord", "term", "tf", "weight"), data, "postings", ["term"])
    index, kept = readers.sparse_index(spark, data, pipelines=["fixed"])
    own = index.join(kept, ["collection_id", "pipeline", "term"])
    return own.select("collection_id", "pipeline", "chunk_ord", "term", "tf", F.round("weight", 6).alias("weight"), "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {PAIRS} SELECT question, answer, count(*) AS n FROM qa GROUP BY ALL")
def ground_truth_round_trip(spark, sf):
    """Pairs written as JSON lines and scanned as ground truth."""
    path = tables.new_path(spark, "truth")
    writers.json_lines(_qa(spark, sf).select("question", "answer"), path)
    return _spread(readers.ground_truth(spark, path), "question", "answer").groupBy("question", "answer").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- dense index


@query("""WITH q AS (SELECT vec_id::INT AS question_idx, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT question_idx, e.vec_id::INT AS chunk_ord, round(CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(v, lambda x: x::DOUBLE * x)) > 0 THEN
  list_sum(list_transform(list_zip(embedding, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)))) ELSE 0 END, 6) AS score FROM embeddings e CROSS JOIN q)
SELECT question_idx, 'vectors' AS collection_id, 'semantic' AS pipeline, rank, score, chunk_ord FROM (SELECT *, row_number() OVER (PARTITION BY question_idx ORDER BY score DESC, chunk_ord)::INT AS rank FROM s) WHERE rank <= 6""")
def retrieve_dense_cosine(spark, sf):
    """Every vector whose vec_id is divisible by 100 against all vectors, in blocks."""
    own = _table(spark, sf, "embeddings")
    vectors = own.select(F.lit("vectors").alias("collection_id"), F.lit("semantic").alias("pipeline"), F.col("vec_id").cast("int").alias("chunk_ord"), "embedding", dense.norm(F.col("embedding")).alias("norm"))
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").cast("int").alias("question_idx"), F.col("embedding").alias("vector"), dense.norm(F.col("embedding")).alias("vector_norm"))
    return dense.retrieve_in_blocks(vectors, asked, D.top_k)


@query()
def embed_and_retrieve(spark, sf):
    """Chunks and questions embedded by the deterministic stand-in for a sentence model."""
    vectors = dense.embed(blocks.numbered(_pages(spark, sf), (SEMANTIC,)), "text", HashEmbedder())
    asked = dense.embed(_questions(spark, sf), "question", HashEmbedder(), tolerant=False).select("question_idx", F.col("embedding").alias("vector"), F.col("norm").alias("vector_norm"))
    return dense.retrieve_vectors(vectors, asked, D.top_k)


# ---------------------------------------------------------------- answers

ANSWERS = f"""asked AS (SELECT h.*, c.text, {_set('qs.question')} AS qw FROM hits h JOIN chunks c USING (collection_id, pipeline, chunk_ord) JOIN qs USING (question_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_idx, collection_id, pipeline ORDER BY len(list_intersect(qw, {_set('text')})) DESC, rank) AS o FROM asked),
answers_ AS (SELECT question_idx, collection_id, pipeline, string_agg(text, ' ' ORDER BY o) AS answer FROM ranked WHERE o <= 4 GROUP BY ALL)"""
ASKED = f"{ALL}, {INDEX}, {_search(BENCH, 6)}, {ANSWERS}"


def _payloads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    questions = _questions(spark, sf)
    return questions, answers.answer_payloads(questions, blocks.retrieve_passages(_pages(spark, sf), chunking.classic(), questions, D.top_k))


@query(f"WITH {ASKED} SELECT question_idx, collection_id, pipeline, md5(answer) AS answer_md5, length(answer) AS answer_chars FROM answers_")
def extractive_answer(spark, sf):
    return _payloads(spark, sf)[1].select("question_idx", "collection_id", "pipeline", F.md5("answer").alias("answer_md5"), F.length("answer").cast("long").alias("answer_chars"))


@query(f"""WITH {ASKED} SELECT question_idx, h.pipeline, rank, score, h.collection_id AS doc_id, page::INT AS page, start::INT AS start, "end"::INT AS "end", section_title, source_file, left(text, 300) AS snippet FROM hits h JOIN chunks USING (collection_id, pipeline, chunk_ord)""")
def answer_payload_sources(spark, sf):
    return _payloads(spark, sf)[1].select("question_idx", "pipeline", F.posexplode("sources").alias("i", "s")).select("question_idx", "pipeline", (F.col("i") + 1).alias("rank"), "s.*")


@query(rf"""WITH {FIXED}, {INDEX}, {_search(BENCH, 6)} SELECT question_idx, collection_id, pipeline, md5(string_agg('[Source ' || rank || ': ' || source_file || ' - Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS chat_md5,
  md5(string_agg('Document ' || collection_id || ', Page ' || page || ', Section: ' || coalesce(section_title, 'None') || chr(10) || text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 5)) AS answer_md5 FROM hits JOIN chunks USING (collection_id, pipeline, chunk_ord) GROUP BY ALL""")
def prompt_contexts(spark, sf):
    own = answers.passages_by_question(blocks.retrieve_passages(_pages(spark, sf), FIXED_CUT, _questions(spark, sf), D.top_k))
    return own.select("question_idx", "collection_id", "pipeline", F.md5(answers.chat_context(F.col("hits"))).alias("chat_md5"), F.md5(answers.answer_context(F.col("hits"))).alias("answer_md5"))


@query(f"WITH {ASKED} SELECT pipeline, round(avg({_jaccard('answer', 'question')}), 6) AS proxy_similarity_mean FROM answers_ JOIN qs USING (question_idx) GROUP BY pipeline")
def evaluate_proxy(spark, sf):
    """The flagship: all questions against all collections and pipelines, answered and scored in one plan."""
    questions, own = _payloads(spark, sf)
    return evaluation.proxy_report(own, questions.withColumn("truth", F.col("question"))).withColumn("proxy_similarity_mean", F.round("proxy_similarity_mean", 6))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_jaccard('question', 'answer')} AS jaccard FROM qa")
def proxy_jaccard(spark, sf):
    return _qa(spark, sf).select("conv_id", "turn", T.jaccard(F.col("question"), F.col("answer")).alias("jaccard"))


@query(f"WITH {PAIRS} SELECT 'p' || (turn % 3) AS pipeline, round(coalesce(avg({_jaccard('answer', 'question')}), 0), 6) AS proxy_similarity_mean FROM qa GROUP BY 1")
def proxy_mean_by_pipeline(spark, sf):
    own = _numbered_qa(spark, sf)
    return evaluation.proxy_report(own.select("question_idx", "pipeline", "answer"), own.select("question_idx", F.col("question").alias("truth"))).withColumn("proxy_similarity_mean", F.round("proxy_similarity_mean", 6))


# ---------------------------------------------------------------- judged metrics


def _numbered_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs as answers: every fifth has a blank answer, every seventh a blank context."""
    own = _qa(spark, sf).withColumns({"question_idx": F.col("conv_id") * 100 + F.col("turn"), "pipeline": F.concat(F.lit("p"), (F.col("turn") % 3).cast("string"))})
    return own


def _flawed(own: DataFrame) -> DataFrame:
    n = F.col("question_idx")
    contexts = F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 7 == 0, F.array(F.col("question"), F.lit(" \n"))).otherwise(F.array(F.col("question"), F.col("answer")))
    return own.withColumn("contexts", contexts).withColumn("answer", F.when(n % 5 == 0, " \t").otherwise(F.col("answer")))


FLAWED = f"""{PAIRS}, n AS (SELECT *, conv_id * 100 + turn AS question_idx, 'p' || (turn % 3) AS pipeline FROM qa),
f AS (SELECT question_idx, pipeline, question, answer AS raw, CASE WHEN question_idx % 5 = 0 THEN '' ELSE answer END AS answer, question_idx % 11 = 0 AS no_context, question_idx % 7 = 0 AS blank_context FROM n),
ok AS (SELECT *, regexp_matches(answer, '{NOT_WS}') AND NOT no_context AND NOT blank_context AS valid FROM f)"""


@query(f"WITH {FLAWED} SELECT pipeline, count(*) AS entries, count(*) FILTER (no_context) AS empty_contexts, count(*) FILTER (NOT regexp_matches(answer, '{NOT_WS}')) AS empty_answers, count(*) FILTER (valid) AS valid FROM ok GROUP BY pipeline")
def metric_validity_filter(spark, sf):
    return evaluation.diagnostics(_flawed(_numbered_qa(spark, sf)))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic metric columns, some null, some no number."""
    own = _flawed(_numbered_qa(spark, sf)).where(evaluation.is_valid())
    n = F.col("question_idx")
    return own.select("pipeline", "question_idx", "question", "answer", F.col("question").alias("truth"), (F.length("answer") / (F.length("question") + 1)).alias("answer_relevancy"), F.when(n % 2 == 0, n % 10 / 10).alias("faithfulness"), F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(n % 4 / 4).alias("context_precision"), F.lit(None).cast("double").alias("context_recall"))


METRIC_ROWS = f"""{FLAWED}, sc AS (SELECT pipeline, question_idx, question, answer, length(answer) / (length(question) + 1)::DOUBLE AS answer_relevancy, CASE WHEN question_idx % 2 = 0 THEN (question_idx % 10) / 10.0::DOUBLE END AS faithfulness,
  CASE WHEN question_idx % 3 <> 0 THEN (question_idx % 4) / 4.0::DOUBLE END AS context_precision, NULL::DOUBLE AS context_recall FROM ok WHERE valid),
long AS (SELECT pipeline, question_idx, question, answer, question AS ground_truth, 'answer_relevancy' AS metric, answer_relevancy AS value FROM sc UNION ALL SELECT pipeline, question_idx, question, answer, question, 'faithfulness', faithfulness FROM sc
  UNION ALL SELECT pipeline, question_idx, question, answer, question, 'context_precision', context_precision FROM sc UNION ALL SELECT pipeline, question_idx, question, answer, question, 'context_recall', context_recall FROM sc)"""
SUMMARY = "summary AS (SELECT pipeline, avg(value) FILTER (metric = 'answer_relevancy') AS answer_relevancy, avg(value) FILTER (metric = 'faithfulness') AS faithfulness, avg(value) FILTER (metric = 'context_precision') AS context_precision, avg(value) FILTER (metric = 'context_recall') AS context_recall FROM long GROUP BY pipeline)"


@query(f"WITH {METRIC_ROWS} SELECT * FROM long")
def metric_unpivot(spark, sf):
    return evaluation.metric_rows(_scores(spark, sf))


@query(f"WITH {METRIC_ROWS}, {SUMMARY} SELECT pipeline, round(answer_relevancy, 6) AS answer_relevancy, round(faithfulness, 6) AS faithfulness, round(context_precision, 6) AS context_precision, context_recall FROM summary")
def metric_summary_null_skipping(spark, sf):
    own = evaluation.metric_summary(evaluation.metric_rows(_scores(spark, sf)))
    return own.withColumns({m: F.round(m, 6) for m in ("answer_relevancy", "faithfulness", "context_precision")})


@query(f"WITH {METRIC_ROWS}, {SUMMARY} SELECT pipeline, round(list_avg([answer_relevancy, faithfulness, context_precision, context_recall]), 6) AS average FROM summary")
def metric_overall(spark, sf):
    return evaluation.overall(evaluation.metric_summary(evaluation.metric_rows(_scores(spark, sf)))).withColumn("average", F.round("average", 6))


@query(f"WITH {METRIC_ROWS} SELECT question_idx, pipeline, metric, CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.3f', round(value::DECIMAL(30, 12), 3)::DOUBLE) END AS shown FROM long")
def metric_format(spark, sf):
    own = evaluation.metric_rows(_scores(spark, sf))
    return own.select("question_idx", "pipeline", "metric", T.three_decimals(F.round("value", 3)).alias("shown"))


def _share(x: str, y: str) -> str:
    return f"CASE WHEN valid AND len({_set(x)}) > 0 THEN len(list_intersect({_set(x)}, {_set(y)}))::DOUBLE / len({_set(x)}) END"


_BOTH = "question || ' ' || raw"
_SHARES = {"answer_relevancy": _share("question", "raw"), "faithfulness": _share("raw", _BOTH), "context_precision": _share("question", _BOTH), "context_recall": _share("question", _BOTH)}
_JUDGED = " UNION ALL ".join(f"SELECT pipeline, question_idx, question, CASE WHEN question_idx % 5 = 0 THEN ' ' || chr(9) ELSE raw END AS answer, question AS ground_truth, '{m}' AS metric, {x} AS value FROM ok" for m, x in _SHARES.items())


@query(f"WITH {FLAWED} {_JUDGED}")
def judged_metrics(spark, sf):
    """The stand-in judge: a row for every answer and metric, null where the answer isn't valid."""
    own = _flawed(_numbered_qa(spark, sf))
    return evaluation.metric_rows(evaluation.judged(own, own.select("question_idx", F.col("question").alias("truth")), OverlapJudge()))


# ---------------------------------------------------------------- ground truth

GT = f"""{PAGES}, {SEGMENTS}, cut AS (SELECT * FROM {_cut(WHOLE, 'ground_truth', 400, 350)}), cand AS (SELECT * FROM cut WHERE length(text) BETWEEN 200 AND 800),
picked AS (SELECT *, row_number() OVER (PARTITION BY collection_id, source_file ORDER BY md5('0|' || collection_id || '|' || source_file || '|' || page || '|' || start), start)::INT AS pick FROM cand)"""


@query(f'WITH {GT} SELECT collection_id, source_file, page::INT AS page, start::INT AS start, "end"::INT AS "end", length(text)::INT AS chars FROM cand')
def gt_candidate_chunks(spark, sf):
    own = groundtruth.candidates(chunking.ground_truth_windows(_pages(spark, sf)))
    return own.select("collection_id", "source_file", "page", "start", "end", F.length("text").alias("chars"))


@query(f"WITH {GT} SELECT collection_id, source_file, start::INT AS start, pick FROM picked WHERE pick <= 10")
def gt_sample(spark, sf):
    own = groundtruth.sample(groundtruth.candidates(chunking.ground_truth_windows(_pages(spark, sf))))
    return own.select("collection_id", "source_file", "start", "pick")


REPLY = "CASE question_idx % 4 WHEN 0 THEN json WHEN 1 THEN 'Here it is: ' || json || ' - done' WHEN 2 THEN 'no object' ELSE '{\"question\": \"only\"}' END"


@query(f"""WITH {PAIRS}, n AS (SELECT conv_id * 100 + turn AS question_idx, question, answer FROM qa), r AS (SELECT question_idx, '{{"question":' || to_json(question) || ',"answer":' || to_json(answer) || '}}' AS json FROM n),
p AS (SELECT question_idx, {REPLY} AS reply FROM r), o AS (SELECT question_idx, try_cast(regexp_extract(reply, '(?s)\\{{.*\\}}') AS JSON) AS j FROM p)
SELECT question_idx, {_strip("j->>'question'")} AS question, {_strip("j->>'answer'")} AS answer FROM o WHERE (j->>'question') IS NOT NULL AND (j->>'answer') IS NOT NULL""")
def llm_json_extract(spark, sf):
    own = _numbered_qa(spark, sf).select("question_idx", F.to_json(F.struct("question", "answer")).alias("json"))
    return groundtruth.parsed_json(own.withColumn("reply", F.expr(REPLY))).select("question_idx", "question", "answer")


_EMPTY_PROMPT = len(groundtruth.TEMPLATE.format(document="", page="", text=""))


@query(f"""WITH {GT} SELECT ({_EMPTY_PROMPT} + length(source_file) + length(page::VARCHAR) + length(text))::VARCHAR || '?' AS question, 'yes' AS answer, source_file AS source_document, page::INT AS page, '' AS doc_section, '' AS chunk_id, 'scripted:1' AS generated_by FROM picked WHERE pick <= 10""")
def generated_ground_truth(spark, sf):
    """The generator with a scripted model."""
    return engine.generate_ground_truth(_pages(spark, sf), ScriptedModel(lambda p: '{"question": "' + str(len(p)) + '?", "answer": "yes"}'))


@query(rf"""WITH {FIXED}, {INDEX}, {_search(BENCH, 6)} SELECT question_idx, collection_id, pipeline, right(string_agg('Document ' || collection_id || ', Page ' || page || ', Section: ' || coalesce(section_title, 'None') || chr(10) || text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 5) || chr(10) || chr(10) || 'Question: ' || question, 80) AS answer,
  NULL::VARCHAR AS error FROM hits JOIN chunks USING (collection_id, pipeline, chunk_ord) JOIN qs USING (question_idx) GROUP BY question_idx, collection_id, pipeline, question""")
def model_answers(spark, sf):
    questions = _questions(spark, sf)
    found = blocks.retrieve_passages(_pages(spark, sf), FIXED_CUT, questions, D.top_k)
    return answers.model_answers(questions, found, ScriptedModel(lambda p: p[-80:])).select("question_idx", "collection_id", "pipeline", "answer", "error")


@query("SELECT question_idx, rank, score, chunk_ord FROM (SELECT conv_id::INT AS question_idx, turn::INT AS chunk_ord, length(text)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn)::INT AS rank FROM conversations) WHERE rank <= 2")
def top_k_per_group(spark, sf):
    own = _table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("question_idx"), F.col("turn").cast("int").alias("chunk_ord"), F.length("text").cast("double").alias("score"))
    return top_k(own, ["question_idx"], 2)
