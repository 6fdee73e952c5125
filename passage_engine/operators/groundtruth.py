"""Question and answer pairs from passages: length filter, sample, prompt, strict parsing of replies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage_engine.config import DEFAULTS
from passage_engine.functions import text as T
from passage_engine.providers import LanguageModel

TEMPLATE = (
    'Write one question that the passage below answers, and its answer, in the language of the passage.\nDocument: {document}, page {page}\nPassage:\n{text}\n\n'
    'Reply with a JSON object alone: {{"question": "...", "answer": "..."}}'
)


def candidates(chunks: DataFrame, least: int = DEFAULTS.min_chars, most: int = DEFAULTS.max_chars) -> DataFrame:
    """Chunks of ``least`` to ``most`` characters."""
    return chunks.where(F.length("text").between(least, most))


def sample(chunks: DataFrame, per_doc: int = DEFAULTS.questions_per_doc, seed: int = 0) -> DataFrame:
    """Up to ``per_doc`` chunks of each document, in an order that only the seed and the chunk decide."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "collection_id", "source_file", F.col("page").cast("string"), F.col("start").cast("string")))
    own = Window.partitionBy("collection_id", "source_file").orderBy(key, "start")
    return chunks.withColumn("pick", F.row_number().over(own)).where(F.col("pick") <= per_doc)


def prompt(template: str = TEMPLATE) -> Column:
    out, fields = [], re.split(r"\{(document|page|text)\}", template)
    for k, part in enumerate(fields):
        if k % 2:
            out.append({"document": T.file_name(F.col("source_file")), "page": F.col("page").cast("string"), "text": F.col("text")}[part])
        else:
            out.append(F.lit(part.replace("{{", "{").replace("}}", "}")))
    return F.concat(*out)


def parse_reply(reply: str | None) -> tuple[str, str] | None:
    """Question and answer of a reply; nothing unless it holds valid JSON with both as strings."""
    clean = (reply or "").strip()
    if not clean.startswith("{"):
        a, b = clean.find("{"), clean.rfind("}")
        if a < 0 or b < a:
            return None
        clean = clean[a : b + 1]
    try:
        found = json.loads(clean)
    except ValueError:
        return None
    if not isinstance(found, dict) or not all(isinstance(found.get(k), str) for k in ("question", "answer")):
        return None
    return found["question"].strip(), found["answer"].strip()


def question_pairs(chunks: DataFrame, model: LanguageModel, template: str = TEMPLATE) -> DataFrame:
    """A ground-truth row for each chunk to which the model gave a valid pair; one call a chunk."""
    asked = chunks.select(F.element_at(F.split("source_file", "/"), -1).alias("source_document"), "page", prompt(template).alias("prompt"))
    schema = "question string, answer string, source_document string, page int, doc_section string, chunk_id string, generated_by string"
    name = model.name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for document, page, text in frame.itertuples(index=False):
                try:
                    found = parse_reply(model.generate(text))
                except Exception:
                    found = None
                if found:
                    rows.append((*found, document, page, "", "", name))
            yield pd.DataFrame(rows, columns=["question", "answer", "source_document", "page", "doc_section", "chunk_id", "generated_by"])

    return asked.mapInPandas(run, schema)


def parsed_json(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """The same without Python: ``from_json`` of the object in a reply. Laxer: it makes strings of other values."""
    found = F.from_json(T.json_object(F.col(reply)), "question string, answer string")
    return rows.withColumn("qa", found).where("qa.question is not null and qa.answer is not null").withColumns({"question": T.strip(F.col("qa.question")), "answer": T.strip(F.col("qa.answer"))}).drop("qa")
