"""What SQL can express of operators whose whole result it can't: the operator's own columns, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import op3_fingerprints
from .hidden_markov import op6_hidden_markov
from .near_dedup import op5_near_dedup
from .quality_rules import op1_quality_rules
from .url_filter import RULES, op8_url_filter

BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda x: x <> '')"


def quality_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT k, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) AS steps(j) GROUP BY k),
facts AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS f FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(f, 1, length(t) // 2)) AS edited_sha256 FROM n
"""


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_near_dedup(spark, sf_dir).select("doc_id", "n_shingles")


SHINGLE_SQL = f"""
WITH d AS (SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1
  ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END::BIGINT AS n_shingles FROM d
"""


def token_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_hidden_markov(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


TOKEN_SQL = f"""
WITH ids AS (SELECT row_number() OVER () AS k, doc_id, text, coalesce(doc_id::VARCHAR, '') AS name FROM documents),
d AS (SELECT k, doc_id, list_append({words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")}, ' ') AS w,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 5 = 1 AS held_out FROM ids),
tokens AS (SELECT k, held_out, unnest(w) AS x FROM d),
counts AS (SELECT x, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY x),
totals AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts),
sums AS (SELECT k, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5)::DOUBLE) - log10((totals.n + 0.5 * (totals.v + 1))::DOUBLE)) AS base_score FROM tokens LEFT JOIN counts USING (x), totals GROUP BY k)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, totals.n AS train_tokens, round(base_score, 6) AS base_score FROM d JOIN sums USING (k), totals
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def rule_case() -> str:
    cases = []
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule}'")
    return f"CASE {' '.join(cases)} END"


URL_SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {rule_case()} AS rule FROM u
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "quality_facts": quality_facts,
    "edited_texts": edited_texts,
    "shingle_counts": shingle_counts,
    "token_base": token_base,
    "url_rules": url_rules,
}
ORACLE_SQL: dict[str, str] = {
    "quality_facts": QUALITY_SQL,
    "edited_texts": EDITED_SQL,
    "shingle_counts": SHINGLE_SQL,
    "token_base": TOKEN_SQL,
    "url_rules": URL_SQL,
}
