"""Token counts by whole-token shortcut.

A SentencePiece BPE model with identity normalisation never merges over the start of a word when none of its
pieces has a word mark after another character: a text is then a row of *pre-tokens* (a word with the spaces
before it) that encode by themselves. ``Shortcut`` proves that for the model, and proves by encoding each
vocabulary string which of them stand alone as one token. A pre-token in that set counts 1 at once; only the
others are merged by the library, once for each distinct one.

Bounds: a task holds one slice of texts and ``LIMIT`` counts. Null texts count as empty (no tokens); repeated rows
each give a row; other columns are not read. Texts that end in a space, or hold the word mark itself, go to the
library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(2)
def _processor(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


class Shortcut(dict):
    """Tokens of each pre-token, as the UTF-8 bytes of a word without the one space before it."""

    LIMIT = 600_000

    def __init__(self, name: str):
        super().__init__()
        self.processor = p = _processor(name)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        alone = [x[1:] for x in pieces if x.startswith(MARK) and MARK not in x[1:] and len(x) > 1]
        self.splits = not any(MARK in x.lstrip(MARK) for x in pieces) and p.normalize("a  b ") == f"{MARK}a{MARK}{MARK}b{MARK}"
        #: Proved by the library itself: these words are one token.
        self.whole = frozenset(x.encode() for x, ids in zip(alone, p.encode(alone, num_threads=1), strict=True) if len(ids) == 1)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.processor.encode(word.decode(), num_threads=1))
        return value

    def count(self, text: bytes) -> int:
        if not text:
            return 0
        if not self.splits or text.endswith(b" ") or b"\xe2\x96\x81" in text:
            return len(self.processor.encode(text.decode(), num_threads=1))
        parts = text.split(b" ")
        if b"" in parts:  # spaces in a row belong to the word after them
            joined, spaces = [], b""
            for x in parts:
                if x:
                    joined.append(spaces + x)
                    spaces = b""
                else:
                    spaces += b" "
            parts = joined
        return sum(map(self.__getitem__, parts))


@lru_cache(1)
def _shortcut(name: str) -> Shortcut:
    return Shortcut(name)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, text: str | Column = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _shortcut(model)
        for batch in C.text_blocks(batches):
            if len(counts) > Shortcut.LIMIT:
                counts.reset()
            texts = C.as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(counts.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = F.col(text) if isinstance(text, str) else text
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
