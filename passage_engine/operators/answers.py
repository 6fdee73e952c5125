"""Answers: extractive ones from the words shared with the question, and those of a language model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from passage_engine.config import DEFAULTS
from passage_engine.functions import text as T
from passage_engine.providers import LanguageModel

SNIPPET, FALLBACK = 300, 600


def extractive_answer(question: Column, passages: Column, max_sentences: int = DEFAULTS.max_sentences) -> Column:
    """The sentences that share most words with the question, ties in order; the start of the first passage if all are blank."""

    def pieces(asked: Column) -> Column:
        one = lambda p, r: F.transform(T.sentences(p), lambda s, i: F.struct((-F.size(F.array_intersect(asked, T.word_set(s)))).alias("less"), r.alias("passage"), i.alias("place"), s.alias("text")))
        return F.slice(F.filter(F.transform(F.array_sort(F.flatten(F.transform(passages, one))), lambda x: x["text"]), T.has_text), 1, max_sentences)

    fallback = F.coalesce(T.prefix(F.get(passages, F.lit(0)), FALLBACK), F.lit(""))
    best = T.let(T.word_set(question), pieces)
    return T.let(best, lambda found: F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(fallback))


def with_passages(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with text and meta, fetched after the ranking for the k rows only."""
    own = ["collection_id", "pipeline", "chunk_ord"]
    meta = F.struct(F.col("collection_id").alias("doc_id"), "page", "start", "end", "section_title", "source_file").alias("meta")
    return candidates.join(chunks.select(*own, "text", meta), own)


def passages_by_question(candidates: DataFrame) -> DataFrame:
    """(question_idx, collection_id, pipeline, hits): the ranked candidates of each question as one array (k of them)."""
    hit = F.struct("rank", "score", "text", "meta")
    return candidates.groupBy("question_idx", "collection_id", "pipeline").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def source_entries(hits: Column) -> Column:
    keys = ("doc_id", "page", "start", "end", "section_title", "source_file")
    return F.transform(hits, lambda h: F.struct(h["score"].alias("score"), *[h["meta"][k].alias(k) for k in keys], T.prefix(h["text"], SNIPPET).alias("snippet")))


def answer_payloads(questions: DataFrame, candidates: DataFrame, max_sentences: int = DEFAULTS.max_sentences) -> DataFrame:
    """(question_idx, question, collection_id, pipeline, answer, sources, contexts)."""
    own = passages_by_question(candidates).join(questions.select("question_idx", "question"), "question_idx")
    contexts = F.transform("hits", lambda h: h["text"])
    return own.select("question_idx", "question", "collection_id", "pipeline", extractive_answer(F.col("question"), contexts, max_sentences).alias("answer"), source_entries(F.col("hits")).alias("sources"), contexts.alias("contexts"))


def answer_context(hits: Column, limit: int = DEFAULTS.llm_passages) -> Column:
    """Context for an answer: the first passages under a header each."""
    one = lambda h: F.concat(F.format_string("Document %s, Page %s, Section: %s\n", h["meta"]["doc_id"], h["meta"]["page"].cast("string"), F.coalesce(h["meta"]["section_title"], F.lit("None"))), h["text"])
    return F.array_join(F.transform(F.slice(hits, 1, limit), one), "\n\n")


def chat_context(hits: Column) -> Column:
    """Context for a chat: each source numbered, with its file and page."""
    one = lambda h, i: F.concat(F.format_string("[Source %s: %s - Page %s]\n", (i + 1).cast("string"), F.coalesce(h["meta"]["source_file"], F.lit("Document")), F.coalesce(h["meta"]["page"].cast("string"), F.lit("N/A"))), h["text"])
    return F.array_join(F.transform(hits, one), "\n\n")


def ask_model(rows: DataFrame, prompt: str, model: LanguageModel, answer: str = "answer") -> DataFrame:
    """Add the model's reply to the column ``prompt``, and ``error``, null where it replied. An error is also the answer's text."""
    schema = StructType([*rows.schema.fields, StructField(answer, StringType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_reply(model, p) for p in frame[prompt]]
            yield frame.assign(**{answer: [a for a, _ in found], "error": [e for _, e in found]})

    return rows.mapInPandas(run, schema)


def _reply(model: LanguageModel, prompt: str) -> tuple[str, str | None]:
    try:
        return model.generate(prompt), None
    except Exception as e:
        return f"The model could not answer: {e}", str(e)


def model_answers(questions: DataFrame, candidates: DataFrame, model: LanguageModel) -> DataFrame:
    """Payloads whose answers a language model wrote from the first passages."""
    own = passages_by_question(candidates).join(questions.select("question_idx", "question"), "question_idx")
    lead = F.lit("Answer from these passages alone and name the document and page you rely on. Say so if they don't hold the answer.\n\n")
    asked = own.withColumn("prompt", F.concat(lead, answer_context(F.col("hits")), F.lit("\n\nQuestion: "), F.col("question")))
    out = ask_model(asked.select("question_idx", "question", "collection_id", "pipeline", "hits", "prompt"), "prompt", model)
    return out.select("question_idx", "question", "collection_id", "pipeline", "answer", "error", source_entries(F.col("hits")).alias("sources"), F.transform("hits", lambda h: h["text"]).alias("contexts"))
