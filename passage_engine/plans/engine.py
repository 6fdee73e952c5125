"""The entry points: ingest, ask, chat, evaluate, generate ground truth. Each is one plan for all questions and pipelines."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine.config import CLASSIC, DEFAULTS, DENSE, Defaults
from passage_engine.functions import text as T
from passage_engine.operators import answers, blocks, chunking, dense, evaluation, groundtruth, sparse
from passage_engine.providers import Embedder, Judge, LanguageModel
from passage_engine.sources import readers, tables, writers


def build_chunks(pages: DataFrame, defaults: Defaults = DEFAULTS, dense_pipelines: tuple[str, ...] = ()) -> DataFrame:
    """Numbered chunks of the three classic pipelines, and of the dense ones named."""
    dense_cuts = [chunking.Cut(name, defaults.fixed_size, defaults.fixed_size - defaults.fixed_overlap) for name in dense_pipelines]
    return blocks.numbered(pages, (*chunking.classic(defaults), *dense_cuts))


def search(chunks: DataFrame, questions: DataFrame, k: int = DEFAULTS.top_k, stop_words: frozenset[str] | None = None) -> DataFrame:
    """Top k of each question in each collection and pipeline of ``chunks`` (a table), the index being made on the way.

    The rows in between carry one number for their collection and pipeline instead of both names.
    """
    names = tables.pin(chunks.select("collection_id", "pipeline").distinct().withColumn("space", F.monotonically_increasing_id()), "spaces")
    coded, own = chunks.join(names, ["collection_id", "pipeline"]).select("space", "chunk_ord", "text"), ["space"]
    tf = tables.pin(sparse.term_frequency(coded, stop_words, own), "tf")
    stats = tables.pin(sparse.term_stats(tf, coded, own), "stats")
    found = sparse.retrieve_unindexed(tf, stats, coded, questions, k, stop_words, own)
    return found.join(names, "space").select("question_idx", "collection_id", "pipeline", "rank", "score", "chunk_ord")


@dataclass
class Engine:
    """Indexes under ``data``; embedders by the name of their pipeline."""

    spark: SparkSession
    data: str
    defaults: Defaults = DEFAULTS
    embedders: dict[str, Embedder] | None = None

    # -------------------------------------------------------- write path

    def ingest(self, path: str, collection_id: str, folder: bool = True, pdf=None) -> DataFrame:
        """Read, cut, index and store; returns the status counts. A dense pipeline that fails is left out and reported."""
        pages = readers.require_pages(readers.pages(self.spark, path, collection_id, pdf, folder))
        return self.ingest_pages(pages)

    def ingest_pages(self, pages: DataFrame) -> DataFrame:
        chunks = tables.pin(build_chunks(pages, self.defaults), "chunks")
        sparse.require_terms(chunks.select(F.explode(T.terms(F.col("text"))).alias("term")))
        writers.store(chunks, self.data, "chunks", ["chunk_ord"])
        collections = tables.pin(pages.select("collection_id").distinct(), "collections")
        kept = readers.chunk_store(self.spark, self.data).where(F.col("pipeline").isin(*CLASSIC)).join(collections, "collection_id", "left_semi")
        tf = tables.pin(sparse.term_frequency(kept), "tf")
        stats = sparse.term_stats(tf, kept)
        writers.store(stats, self.data, "term_stats", ["term"])
        writers.store(sparse.postings(tf, stats), self.data, "postings", ["term"])
        failed = {}
        for name, embedder in (self.embedders or {}).items():
            try:
                self._ingest_dense(pages, name, embedder)
            except Exception as e:
                failed[name] = str(e)
        done = evaluation.status(readers.chunk_store(self.spark, self.data).join(collections, "collection_id", "left_semi"))
        notes = self.spark.createDataFrame([(k, v) for k, v in failed.items()], "pipeline string, error string")
        return done.withColumn("error", F.lit(None).cast("string")).unionByName(notes, allowMissingColumns=True)

    def _ingest_dense(self, pages: DataFrame, name: str, embedder: Embedder) -> None:
        cut = tables.pin(chunking.semantic(pages, self.defaults.fixed_size, self.defaults.fixed_overlap, name), "cut")
        chunks = tables.pin(chunking.numbered(cut), "chunks")
        vectors = dense.embed(chunks, "text", embedder).select("collection_id", "pipeline", "chunk_ord", "embedding", "norm")
        writers.store(vectors, self.data, "chunk_vectors", ["chunk_ord"])  # first, so that no chunks stand without vectors
        writers.store(chunks, self.data, "chunks", ["chunk_ord"])

    # -------------------------------------------------------- read path

    def candidates(self, questions: DataFrame, collection_id: str, pipelines: tuple[str, ...] = CLASSIC, k: int | None = None) -> DataFrame:
        """Top k chunks, with text and meta, of each question and pipeline."""
        k = self.defaults.top_k if k is None else k
        chunks = readers.chunk_store(self.spark, self.data, collection_id, list(pipelines))
        classic, vector = [p for p in pipelines if p not in DENSE], [p for p in pipelines if p in (self.embedders or {})]
        for name in (p for p in pipelines if p in DENSE and p not in vector):
            warnings.warn(f"{name} is left out: it has no embedder", stacklevel=2)
        if not classic and not vector:
            raise LookupError("no pipeline to ask")
        found = None
        if classic:
            index, stats = readers.sparse_index(self.spark, self.data, collection_id, classic)
            found = sparse.retrieve(index, stats, chunks.where(F.col("pipeline").isin(classic)), questions, k)
        for name in vector:
            asked = dense.embed(questions.select("question_idx", "question"), "question", (self.embedders or {})[name], tolerant=False)
            asked = asked.select("question_idx", F.col("embedding").alias("vector"), F.col("norm").alias("vector_norm"))
            own = dense.retrieve_vectors(readers.dense_index(self.spark, self.data, collection_id, [name]), asked, k)
            found = own if found is None else found.unionByName(own)
        return answers.with_passages(found, chunks)

    def ask(self, questions: DataFrame, collection_id: str, pipelines: tuple[str, ...] = CLASSIC, k: int | None = None, max_sentences: int | None = None, model: LanguageModel | None = None) -> DataFrame:
        found = self.candidates(questions, collection_id, pipelines, k)
        if model is not None:
            return answers.model_answers(questions, found, model).drop("contexts")
        return answers.answer_payloads(questions, found, max_sentences or self.defaults.max_sentences).drop("contexts")

    def ask_json(self, question: str, collection_id: str, **how) -> dict:
        """One question, as the REST interface gives it."""
        asked = self.spark.createDataFrame([(0, question, None)], "question_idx int, question string, truth string")
        rows = writers.as_json(self.ask(asked, collection_id, **how).orderBy("pipeline").select("pipeline", "answer", "sources")).collect()
        return {"doc_id": collection_id, "question": question, "results": [json.loads(r[0]) for r in rows]}

    def chat(self, question: str, collection_id: str, model: LanguageModel, pipeline: str = "azure_semantic", k: int | None = None) -> dict:
        """A model's answer with previews of its sources; the previews and the error if it fails."""
        asked = self.spark.createDataFrame([(0, question, None)], "question_idx int, question string, truth string")
        own = answers.passages_by_question(self.candidates(asked, collection_id, (pipeline,), k))
        shown = F.transform("hits", lambda h: F.struct(h["rank"].alias("rank"), T.three_decimals(h["score"]).alias("score"), h["meta"]["source_file"].alias("source_file"), h["meta"]["page"].alias("page"), T.preview(h["text"]).alias("preview")))
        row = own.select(answers.chat_context(F.col("hits")).alias("context"), shown.alias("sources")).head()
        if row is None:
            raise LookupError("no passage was found")
        out = {"question": question, "sources": [s.asDict() for s in row["sources"]]}
        try:
            return out | {"answer": model.generate(f"Use these sources and name them.\n\n{row['context']}\n\nQuestion: {question}"), "error": None}
        except Exception as e:
            return out | {"answer": None, "error": str(e)}

    def evaluate(self, questions: DataFrame, collection_id: str, k: int | None = None, max_sentences: int = 4, local_proxy: bool = True, judge: Judge | None = None, use_llm: bool = False, export: str | None = None, model: LanguageModel | None = None) -> dict:
        """Reports over the classic pipelines: mean word overlap, and judged metrics if there is a judge and ``use_llm``.

        With ``use_llm`` and a ``model``, the model writes the answers; they are written once, as calls cost.
        """
        found = self.candidates(questions, collection_id, CLASSIC, k)
        if use_llm and model is not None:
            own = tables.pin(answers.model_answers(questions, found, model), "answers")
        else:
            own = answers.answer_payloads(questions, found, max_sentences)
        out: dict = {}
        if local_proxy:
            out |= {f"{r['pipeline']}_proxy": {"proxy_similarity_mean": r["proxy_similarity_mean"]} for r in evaluation.proxy_report(own, questions).collect()}
        if judge is not None and not use_llm:
            out["warning"] = "judged metrics need model answers to be allowed"
        elif judge is not None:
            rows = evaluation.metric_rows(evaluation.judged(own, questions, judge))
            summary = evaluation.metric_summary(rows)
            if export:
                writers.summary_csv(summary, f"{export}/ragas_summary.csv")
                writers.per_question_csv(rows, f"{export}/ragas_per_question.csv")
            out["summary"] = {r["pipeline"]: {k: v for k, v in r.asDict().items() if k != "pipeline"} for r in summary.collect()}
            out["average"] = {r["pipeline"]: r["average"] for r in evaluation.overall(summary).collect()}
        return out


def generate_ground_truth(pages: DataFrame, model: LanguageModel, defaults: Defaults = DEFAULTS, seed: int = 0) -> DataFrame:
    """Question and answer rows: windows, length filter, a sample of each document, one model call a chunk."""
    cut = chunking.ground_truth_windows(pages, defaults.truth_size, defaults.truth_overlap)
    return groundtruth.question_pairs(groundtruth.sample(groundtruth.candidates(cut, defaults.min_chars, defaults.max_chars), defaults.questions_per_doc, seed), model)
