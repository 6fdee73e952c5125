"""Text functions as Spark columns: tokens, headings, terms, sentences, strips. All stay in the JVM.

The character classes are spelled out, as Java's own word and space classes are ASCII unless flagged, and differ
from Unicode's in places when flagged.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes and patterns.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"({WORD}+|{NOT_WS})"
MARK = r" ?([^\p{L}\p{N}_ ]) ?"
CASED = r"A-Z\x{130}\x{131}\x{17f}\x{212a}"
HEADING = rf"(?imdu)^({WS}*(?:Article{WS}+\p{{Nd}}+|Section{WS}+\p{{Nd}}+|Chapitre{WS}+\p{{Nd}}+|[{CASED}][{CASED}0-9 \-]{{4,}})){WS}*$"


def tokens(text: Column) -> Column:
    """Runs of word characters, and single other characters that aren't space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def join_tokens(parts: Column) -> Column:
    """Tokens as text, with a space between two words only."""
    return F.regexp_replace(F.array_join(parts, " "), MARK, "$1")


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's classes."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(NOT_WS), F.lit(False))


def heading_titles(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), strip)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def segments(text: Column) -> Column:
    """(title, body) after each heading up to the next; text before the first is left out; all of it, untitled, if there is none."""
    alone = F.array(F.struct(F.lit(None).cast("string").alias("title"), text.alias("body")))

    def paired(x: Column) -> Column:
        bodies = F.slice(x["bodies"], 2, F.greatest(F.size(x["bodies"]) - 1, F.lit(0)))
        titled = F.zip_with(x["titles"], bodies, lambda t, b: F.struct(strip(t).alias("title"), b.alias("body")))
        return F.when(F.size(x["titles"]) == 0, alone).otherwise(titled)

    return let(F.struct(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)).alias("titles"), F.split(text, HEADING, -1).alias("bodies")), paired)


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}+)"), F.lit(1)))


def terms(text: Column, stop_words: frozenset[str] | None = None) -> Column:
    """Lower-case words of two characters and more, but for stop words, with repeats."""
    stop = sorted(english_stop_words() if stop_words is None else stop_words)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}{{2,}})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def term_counts(text: Column, stop_words: frozenset[str] | None = None) -> Column:
    """Array of (term, tf), each term of ``terms`` once, counted inside the row."""

    def runs(found: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        counted = lambda at: F.transform(at, lambda p, j: F.struct(F.get(found, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(found)) - p).cast("long").alias("tf")))
        return F.when(F.size(found) > 0, let(starts, counted))

    return let(F.sort_array(terms(text, stop_words)), runs)


@lru_cache(1)
def english_stop_words() -> frozenset[str]:
    lines = (Path(__file__).parents[1] / "resources" / "stop_words_en.txt").read_text(encoding="utf-8").splitlines()
    return frozenset(w for x in lines if not x.startswith("#") for w in x.split())


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, an exclamation or a question mark."""
    return F.split(text, rf"(?<=[.!?]){WS}+", -1)


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 150) -> Column:
    return F.when(F.length(text) > n, F.concat(prefix(text, n), F.lit("..."))).otherwise(text)


def three_decimals(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.3f", x))


def finite(x: Column) -> Column:
    """As a double; null for what is no number."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words; 0 if either side has none."""
    def share(s: Column) -> Column:
        return F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))).otherwise(0.0)

    return let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), share)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def json_object(reply: Column) -> Column:
    """The whole reply if it starts with a brace, else from its first brace to its last; empty without one."""
    clean = strip(reply)
    return F.when(clean.startswith("{"), clean).otherwise(F.regexp_extract(clean, r"(?s)(\{.*\})", 1))
