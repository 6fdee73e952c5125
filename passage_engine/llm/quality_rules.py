"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document: the ledger stores what was measured and one failure bit a rule.
Policies are versioned masks over those bits, applied later without reading the texts again; ablations come from
counts of equal masks, combined by bitwise aggregation.

Words are runs of anything but ASCII white space. Null texts have none. Repeated rows each give a row; other
columns are not read. Three-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage_engine.llm import common as C

SPACE = r"\x20\x09-\x0D"
#: Rule names in order of their bits, and when they fail, over the ledger's measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: Policy versions: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measure(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """``keep`` and the measurements of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keep, text.alias("__t")).withColumn("__w", C.words(F.col("__t")))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "n_capitals": F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long"),
        "__g": F.when(F.size("__w") > 2, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]))),
    }).drop("__t", "__w", "__l")
    # only texts with an equal pair of windows are sorted; equal neighbours are the repeated windows
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    out = out.withColumn("__s", F.when(some, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("__g")
    near = lambda x, k: (x["g"] == F.get("__s", k - 1)["g"]) | (x["g"] == F.get("__s", k + 1)["g"])
    out = out.withColumn("__p", F.sort_array(F.transform(F.filter("__s", near), lambda x: x["i"])))
    # windows cover three words each, less where the next one starts
    covered = F.aggregate(F.sequence(F.lit(1), F.size("__p") - 1), F.lit(3), lambda n, k: n + F.least(F.lit(3), F.col("__p")[k] - F.col("__p")[k - 1]))
    return C.settled(out.withColumn("n_repeat_words", F.when(F.col("__p").isNull(), 0).otherwise(covered).cast("long")).drop("__s", "__p"))


def ledger(docs: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """Measurements and ``failures``, a bit for each rule, of each row; with doc_id or what ``keep`` names."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, [F.col("doc_id").cast("long").alias("doc_id")] if keep is None else keep).withColumn("failures", total)


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with the base verdict and that of ``policy`` on top of it."""
    base = ~passes("base")
    out = ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(policy), "policy": F.lit(policy)})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "policy")


def keep_passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the base rules and ``policy``."""
    own = ledger(docs.select(F.struct("*").alias("__doc"), "text"), ["__doc"])
    return own.where(passes("base") & passes(policy)).select("__doc.*")


def ablations(own: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of ``policy``: rows that fail it, rows that fail no other, and the mask of rules failed along with it.

    Reads one count for each mask that occurs (at most 2 to the number of rules), never the texts.
    """
    at = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])))
    counts = own.select(at.alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in POLICIES[policy]])).alias("x")
    each = counts.select("m", "n", rules).select("m", "n", "x.*").where(F.col("m").bitwiseAND(F.col("bit")) > 0)
    return each.groupBy("rule").agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"), F.bit_or(F.col("m").bitwiseXOR(F.col("bit"))).alias("failed_along"))
