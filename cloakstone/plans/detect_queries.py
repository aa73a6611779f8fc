"""Queries over the detectors and checks, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.functions.checks import hmac_sha256, normalize_digits, verhoeff_digit, verhoeff_valid
from cloakstone.functions.checks import INVERSE, PRODUCTS, TURNS
from cloakstone.operators.column_names import entity_expression
from cloakstone.operators.context import CONTEXT_DETECTORS, GIVEN_NAMES
from cloakstone.operators.decisions import tool_fits
from cloakstone.operators.detectors import BY_NAME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SALT = "fixed-salt"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(df: DataFrame, key: str, text: Column, detector) -> DataFrame:
    """key, span_start, span_end, value, confidence of a detector's spans."""
    rows = df.select(key, text.alias("_t")).select(key, "_t", F.explode(detector.spans(F.col("_t"))).alias("s"))
    return rows.select(key, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.substring(F.col("_t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.col("s.confidence").alias("confidence"))


def found_sql(source: str, key: str, text: str, pattern: str, confidence: str, keep: str = "true") -> str:
    """The same where the pattern needs no look-around. ``value`` is the match."""
    return f"""
WITH cut AS (SELECT {key}, string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM {source}),
each AS (SELECT {key}, p, unnest(range(2, len(p) + 1, 2)) AS i FROM cut),
spans AS (SELECT {key}, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::INT AS span_start, p[i] AS value FROM each)
SELECT {key}, span_start, (span_start + length(value))::INT AS span_end, value, ({confidence})::DOUBLE AS confidence FROM spans WHERE {keep}"""


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# documents

add("detect_email", lambda s, d: found(load(s, d, "documents"), "doc_id", F.col("text"), BY_NAME["email"]), found_sql("documents", "doc_id", "text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "0.95"))

DOUBLED = "regexp_replace(' ' || text || ' ', '([^0-9.])', '\\1\\1', 'g')"


def _values(detector: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: found(load(s, d, "documents"), "doc_id", F.col("text"), BY_NAME[detector]).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


LUHN = "(list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 1 THEN (2 * substr({d}, i, 1)::INT) - (CASE WHEN substr({d}, i, 1)::INT > 4 THEN 9 ELSE 0 END) ELSE substr({d}, i, 1)::INT END)) % 10 = 0)"
add("detect_ip", _values("ip_address"), f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all({DOUBLED}, '[^0-9.]((?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})[^0-9.]', 1)) AS value FROM documents)
SELECT doc_id, value, count(*) AS n FROM m WHERE len(list_filter(string_split(value, '.'), lambda o: o::INT > 255)) = 0 GROUP BY ALL""")
add("detect_card_luhn", _values("credit_card"), f"""
WITH m AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all({DOUBLED}, '[^0-9.]((?:[0-9](?:\\s\\s|--)?){{12,18}}[0-9])[^0-9.]', 1)), '([^0-9])[^0-9]', '\\1', 'g') AS value FROM documents),
n AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM m)
SELECT doc_id, value, count(*) AS n FROM n WHERE {LUHN.format(d="d")} GROUP BY ALL""")

# numbers made from keys; the same arithmetic in both engines

PHONE_TEXT = ("tel +91 9", ", alt 0")
add(
    "detect_phone_in",
    lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.lit(PHONE_TEXT[0]), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(PHONE_TEXT[1]), (F.col("c_custkey") + 6000000000).cast("string"), F.lit(".")), BY_NAME["phone_in"]),
    found_sql("customer", "c_custkey", f"('{PHONE_TEXT[0]}' || lpad(c_custkey::VARCHAR, 9, '0') || '{PHONE_TEXT[1]}' || (c_custkey + 6000000000) || '.')", r"(?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}", "0.9"),
)
add(
    "detect_phone_intl",
    lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.lit("ring +44 20 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0"), F.lit(" now")), BY_NAME["phone_intl"]),
    found_sql("customer", "c_custkey", "('ring +44 20 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') || ' now')", r"\+\d{1,3}[\s-]?\d{2,4}(?:[\s-]?\d{2,4}){1,3}", "0.7"),
)


def grouped_digits() -> Column:
    n = (F.col("o_orderkey") * 7919 + 200000000000).cast("string")
    return F.when(F.col("o_orderkey") % 2 == 0, n).otherwise(F.concat(F.substring(n, 1, 4), F.lit(" "), F.substring(n, 5, 4), F.lit(" "), F.substring(n, 9, 4)))


GROUPED_SQL = "CASE WHEN o_orderkey % 2 = 0 THEN n ELSE n[1:4] || ' ' || n[5:8] || ' ' || n[9:12] END"
VERHOEFF = f"list_reduce(list_transform(range(1, len({{d}}) + 1), lambda i: {TURNS}[(((i - 1 + {{shift}}) % 8) * 10 + reverse({{d}})[i]::INT + 1)::INT]), lambda a, x: {PRODUCTS}[(a * 10 + x + 1)::INT], 0)"
add(
    "detect_aadhaar",
    lambda s, d: found(load(s, d, "orders"), "o_orderkey", F.concat(F.lit("id "), grouped_digits(), F.lit(" end")), BY_NAME["aadhaar"]),
    f"""
WITH o AS (SELECT o_orderkey, (o_orderkey * 7919 + 200000000000)::VARCHAR AS n FROM orders), v AS (SELECT *, {GROUPED_SQL} AS value FROM o)
SELECT o_orderkey, 3 AS span_start, (3 + length(value))::INT AS span_end, value, CASE WHEN o_orderkey % 2 = 0 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM v WHERE {VERHOEFF.format(d="n", shift=0)} = 0""",
)
PAN_SQL = "(translate(lpad((c_custkey % 100000)::VARCHAR, 5, '0'), '0123456789', 'ABCDEFGHIJ') || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'K')"


def pan_text() -> Column:
    return F.concat(F.translate(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("K"))


def ifsc_text() -> Column:
    return F.concat(F.lit("SBIN0"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"))


add("detect_pan", lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.lit("pan:"), pan_text(), F.lit(".")), BY_NAME["pan"]), f"SELECT c_custkey, 4 AS span_start, 14 AS span_end, {PAN_SQL} AS value, CASE WHEN {PAN_SQL}[4] IN ('A','B','C','F','G','H','L','J','P','T') THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM customer")
add("detect_ifsc", lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.lit("at "), ifsc_text()), BY_NAME["ifsc"]), "SELECT c_custkey, 3 AS span_start, 14 AS span_end, 'SBIN0' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS value, 0.8::DOUBLE AS confidence FROM customer")


def _secrets(s: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("k AKIA"), F.upper(F.substring(h, 1, 16)), F.lit(" ghp_"), F.concat(h, F.substring(h, 1, 4)), F.lit(" eyJ"), h, F.lit(".eyJ"), h, F.lit("."), h)
    df = load(s, d, "customer").select("c_custkey", text.alias("t"))
    parts = [found(df, "c_custkey", F.col("t"), BY_NAME[n]).withColumn("entity_type", F.lit(BY_NAME[n].entity_type)) for n in ("aws_access_key", "github_token", "jwt")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("c_custkey", "entity_type", "span_start", "span_end", "value")


add("detect_secrets", _secrets, """
WITH h AS (SELECT c_custkey, md5(c_custkey::VARCHAR) AS h FROM customer)
SELECT c_custkey, 'AWS_ACCESS_KEY' AS entity_type, 2 AS span_start, 22 AS span_end, 'AKIA' || upper(h[1:16]) AS value FROM h
UNION ALL SELECT c_custkey, 'GITHUB_TOKEN', 23, 63, 'ghp_' || h || h[1:4] FROM h
UNION ALL SELECT c_custkey, 'JWT', 64, 167 + 1, 'eyJ' || h || '.eyJ' || h || '.' || h FROM h""")

# checks

add("verhoeff_check", lambda s, d: load(s, d, "orders").select("o_orderkey", verhoeff_valid((F.col("o_orderkey") * 7919 + 200000000000).cast("string")).alias("valid")), f"WITH o AS (SELECT o_orderkey, (o_orderkey * 7919 + 200000000000)::VARCHAR AS n FROM orders) SELECT o_orderkey, {VERHOEFF.format(d='n', shift=0)} = 0 AS valid FROM o")
add("verhoeff_digit", lambda s, d: load(s, d, "orders").select("o_orderkey", verhoeff_digit((F.col("o_orderkey") * 104729).cast("string")).alias("digit")), f"WITH o AS (SELECT o_orderkey, (o_orderkey * 104729)::VARCHAR AS n FROM orders) SELECT o_orderkey, {INVERSE}[({VERHOEFF.format(d='n', shift=1)} + 1)::INT] AS digit FROM o")
ASCII, DEVANAGARI, ARABIC = "0123456789", "०१२३४५६७८९", "٠١٢٣٤٥٦٧٨٩"
add(
    "normalize_digits",
    lambda s, d: load(s, d, "customer").select("c_custkey", normalize_digits(F.concat(F.translate(F.col("c_custkey").cast("string"), ASCII, DEVANAGARI), F.lit("²-"), F.translate((F.col("c_custkey") * 3).cast("string"), ASCII, ARABIC))).alias("plain")),
    "SELECT c_custkey, c_custkey || '²-' || (c_custkey * 3) AS plain FROM customer",
)
add("hmac_values", lambda s, d: load(s, d, "customer").select("c_custkey", hmac_sha256(SALT, F.col("c_name")).alias("value_hmac")), "SELECT c_custkey, " + (
    HMAC_SQL := f"sha256(unhex('{bytes(b ^ 0x5C for b in SALT.encode().ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in SALT.encode().ljust(64, bytes(1))).hex()}') || encode({{v}}))))"
).format(v="c_name") + " AS value_hmac FROM customer")
add(
    "hmac_correlate",
    lambda s, d: load(s, d, "customer").select(hmac_sha256(SALT, F.col("c_mktsegment")).alias("value_hmac")).groupBy("value_hmac").agg(F.count("*").alias("n")),
    f"SELECT {HMAC_SQL.format(v='c_mktsegment')} AS value_hmac, count(*) AS n FROM customer GROUP BY 1",
)

# names, globs, context

NAMES = [("c_name", "PERSON_NAME"), ("file_name", None), ("e-mail", "EMAIL"), ("user_dob", None), ("dob", "DOB"), ("Phone No", "PHONE"), ("pan_number", "PAN"), ("khata_no", "BANK_ACCOUNT"), ("pincode", "ADDRESS"), ("ssn", "GOVT_ID"), ("user_ssn", None), ("status", None), ("ifsc", "IFSC"), ("aadhar", "AADHAAR"), ("नाम", "PERSON_NAME"), ("गाँव", None)]


def _names(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in NAMES])
    return load(s, d, "nation").select("n_nationkey", F.get(names, F.col("n_nationkey") % len(NAMES)).alias("name")).select("n_nationkey", "name", entity_expression(F.col("name")).alias("entity_type"))


_text = lambda v: "NULL" if v is None else f"'{v}'"
add("column_name_scan", _names, f"SELECT n_nationkey, x.name, x.e AS entity_type FROM nation JOIN (VALUES {', '.join(f'({i}, {_text(n)}, {_text(e)})' for i, (n, e) in enumerate(NAMES))}) x(i, name, e) ON n_nationkey % {len(NAMES)} = x.i")
add("tool_glob", lambda s, d: load(s, d, "events").select("event_id", tool_fits(F.col("event_type"), ["s*", "?iew", "[!a-d]*r"]).alias("fits")), "SELECT event_id, event_type GLOB 's*' OR event_type GLOB '?iew' OR event_type GLOB '[!a-d]*r' AS fits FROM events")
_CTX = {d.name: d for d in CONTEXT_DETECTORS}
add(
    "context_boost",
    lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "income tax ").otherwise("order no "), pan_text()), _CTX["pan_context"]).select("c_custkey", "value", "confidence"),
    f"SELECT c_custkey, {PAN_SQL} AS value, CASE WHEN c_custkey % 3 = 0 THEN 0.65 ELSE 0.3 END::DOUBLE AS confidence FROM customer",
)
add(
    "name_denylist",
    lambda s, d: found(load(s, d, "customer"), "c_custkey", F.concat(F.lit("met "), F.get(F.array(*map(F.lit, GIVEN_NAMES)), (F.col("c_custkey") % len(GIVEN_NAMES)).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "s twice").otherwise(" twice")), _CTX["given_name"]),
    f"WITH n AS (SELECT c_custkey, {GIVEN_NAMES}[(c_custkey % {len(GIVEN_NAMES)} + 1)::INT] AS value FROM customer WHERE c_custkey % 2 = 1) SELECT c_custkey, 4 AS span_start, (4 + length(value))::INT AS span_end, value, 0.65::DOUBLE AS confidence FROM n",
)
