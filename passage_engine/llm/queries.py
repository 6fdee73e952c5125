"""The corpus operators as queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passage_engine.llm import common as C
from passage_engine.llm import decontaminate, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, token_store


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(C.load(spark, sf_dir, "documents"), C.new_path(spark, "store"))
    return token_store.read_digests(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(C.load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(C.load(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(C.load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_substrings(C.load(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.load(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.load(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(C.load(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, C.load(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_line_dedup, op3_quality_rules, op4_token_counts, op5_decontamination, op6_substring_dedup, op7_near_dedup, op8_mixing, op9_sharding, op10_quality_classifier)
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = f"translate(text, '{C.UPPER}', '{C.LOWER}')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
own AS (SELECT * FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
cls AS (SELECT line, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM own GROUP BY line),
sh AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(line) - {line_dedup.CHARS} + 2, 2)), lambda i: substr(line, i, {line_dedup.CHARS}))) AS g FROM cls),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= {line_dedup.PERCENT} * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS r FROM cls UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
rep AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT own.doc_id, own.line_no::INT AS line_no, c.first[1] AS rep_doc_id, c.first[2]::INT AS rep_line_no, own.doc_id = c.first[1] AND own.line_no = c.first[2] AS kept
FROM own JOIN cls ON own.line = cls.line JOIN rep ON rep.id = cls.id JOIN cls c ON c.id = rep.root""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_own_lines,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals FROM d),
x AS (SELECT m.*, n_lines - n_own_lines AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
y AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality_rules.RULES.values()))} AS failures FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (failures & {quality_rules.mask(quality_rules.BASE)}) <> 0 AS base_failed, failures = 0 AS kept, failures::INT AS failures, 'v1' AS policy FROM y""",
    "op5_decontamination": rf"""
WITH i AS (SELECT item_id, {WORDS.format(FOLDED)} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(5, len(w)) AS run, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k : k + least(5, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
d AS (SELECT doc_id, {WORDS.format(FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, run, unnest(list_transform(range(1, len(w) - run + 2), lambda k: array_to_string(w[k : k + run - 1], ' '))) AS g FROM d, (SELECT DISTINCT run FROM q) WHERE len(w) >= run)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared FROM q JOIN s USING (run, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 10 * count(*) >= 8 * n""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) > 12),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM win),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
bad AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN f USING (g), (SELECT unnest(range(13)) AS k) WHERE f.first < g.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN bad ON p.doc_id = bad.doc_id AND p.i = bad.i WHERE bad.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op7_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"coalesce({FOLDED}, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
