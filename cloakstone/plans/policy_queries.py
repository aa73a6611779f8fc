"""Queries over policies, rewriting, audit, tokens, payloads and decisions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.operators import report
from cloakstone.operators.decisions import prompt_decision, summary, tool_input_decision
from cloakstone.operators.json_scan import json_leaves, scan_json
from cloakstone.operators.rewrite import clusters, partial_mask
from cloakstone.operators.vault import Vault, rehydrate, tokenize_rows
from cloakstone.sources.audit import filter_audit, read_audit, write_audit
from cloakstone.sources.steps import shared_path
from cloakstone.streaming.confirm import confirm_batch, confirm_stream, digest

from .detect_queries import DOUBLED, HMAC_SQL, LUHN, PAN_SQL, SALT, ifsc_text, load, pan_text
from .guard import Guard, audit_events
from .policy import PRESETS, load_preset, parse_policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
WHEN = "2024-05-01 12:00:00"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def policy_of(action: str, *entities: str, default: str = "allow", **more) -> object:
    return parse_policy({"name": "own", "defaults": {"unknown_entity_action": default, **more}, "rules": [{"id": "r1", "entities": list(entities), "action": action}]})


# the flagship: documents under a preset


def scan_documents(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").select("doc_id", "text")
    out = Guard(load_preset("ngo-default"), SALT).scan(docs, "documents", columns=["text"])
    return out.select("doc_id", F.col("text").alias("clean"), F.size("events").cast("long").alias("n_events"), F.col("guard.modified").alias("modified"))


CARDS = f"""
cards AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all({DOUBLED}, '[^0-9.]((?:[0-9](?:\\s\\s|--)?){{12,18}}[0-9])[^0-9.]', 1)), '([^0-9])[^0-9]', '\\1', 'g') AS v FROM documents),
good AS (SELECT doc_id, v FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM cards) WHERE {LUHN.format(d="d")}),
ips AS (SELECT doc_id, unnest(regexp_extract_all({DOUBLED}, '[^0-9.]((?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})[^0-9.]', 1)) AS v FROM documents),
n AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id FROM good UNION ALL SELECT doc_id FROM ips WHERE len(list_filter(string_split(v, '.'), lambda o: o::INT > 255)) = 0
  UNION ALL SELECT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) FROM documents)) GROUP BY doc_id),
lists AS (SELECT doc_id, list(v) AS vs FROM good GROUP BY doc_id)"""
EMAIL_MASK = r"regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***@\2', 'g')"
add("scan_documents", scan_documents, f"""
WITH {CARDS}, c AS (SELECT doc_id, text, coalesce(k, 0) AS n_events, list_reduce(coalesce(vs, []::VARCHAR[]), lambda a, x: replace(a, x, '[BLOCKED:ngo-default/govt-financial-block]'), {EMAIL_MASK}) AS clean FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN lists USING (doc_id))
SELECT doc_id, clean, n_events, clean <> text AS modified FROM c""")

# policies

ENTITY_ACTIONS = {p: {e: load_preset(p).resolve(e)[0] for e in ("JWT", "AADHAAR", "CREDIT_CARD", "EMAIL", "PERSON_NAME", "DOB", "IP_ADDRESS", "IFSC", "UPI_ID")} for p in PRESETS}


def _resolve(s: SparkSession, d: str) -> DataFrame:
    rows = [(p, e, *(lambda a, r: (a, r.id if r else None))(*load_preset(p).resolve(e))) for p in PRESETS for e in ENTITY_ACTIONS["dev"]]
    rules = s.createDataFrame(rows, "policy string, entity_type string, action string, rule_id string")
    wanted = load(s, d, "events").select(F.get(F.array(*map(F.lit, ENTITY_ACTIONS["dev"])), (F.col("event_id") % 9).cast("int")).alias("entity_type"), F.get(F.array(*map(F.lit, PRESETS)), (F.col("user_id") % 7).cast("int")).alias("policy"))
    return wanted.join(F.broadcast(rules), ["policy", "entity_type"]).groupBy("policy", "entity_type", "action").agg(F.count("*").alias("n"))


#: What each preset does, entity by entity, written out apart from the presets.
DECISIONS = """
personal block block block partial_mask allow allow allow allow allow
ngo-default block block block partial_mask mask redact allow allow mask
strict block block block block block block block block block
dev mask mask allow allow allow allow allow allow allow
dpdp block block block mask mask redact mask allow mask
gdpr block block block mask mask redact mask allow mask
hipaa-lite block block block block block block block allow block
""".split("\n")[1:-1]
_VALUES = ", ".join(f"({i}, '{line.split()[0]}', {j}, '{e}', '{line.split()[j + 1]}')" for i, line in enumerate(DECISIONS) for j, e in enumerate(ENTITY_ACTIONS["dev"]))
add("resolve_rules", _resolve, f"SELECT x.policy, x.entity_type, x.action, count(*) AS n FROM events JOIN (VALUES {_VALUES}) x(i, policy, j, entity_type, action) ON user_id % 7 = x.i AND event_id % 9 = x.j GROUP BY ALL")

#: Path patterns, and the same over the leaves of the rows below as SQL: (pattern, condition on key and index).
PATHS = [("$.a.name", "key = 'a.name'"), ("$.*", "key = 'a'"), ("$..name", "key IN ('a.name', 'l.name')"), ("$.l[1].name", "key = 'l.name' AND i = 1"), ("$.l[*].name", "key = 'l.name'"), ("$.l[*]", "false"), ("$..l..*", "key LIKE 'l.%'"), ("$..", "true"), ("$.l[0]..size", "key = 'l.size' AND i = 0")]


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Which of the leaves {a: {name}, l: [{name, size}, {name, size}]} of each row a pattern reaches."""
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    df = load(s, d, "part").select("p_partkey", F.struct(F.col("p_name").alias("name")).alias("a"), F.array(item, item).alias("l"))
    out = None
    for pattern, _ in PATHS:
        policy = parse_policy({"name": "p", "defaults": {"unknown_entity_action": "allow"}, "rules": [{"id": "r", "match": {"json_path": pattern}, "action": "redact"}]})
        hit = Guard(policy, SALT).scan(df, columns=["a", "l"])
        one = hit.select("p_partkey", F.lit(pattern).alias("pattern"), F.array_join(F.array_sort(F.transform("events", lambda e: e["json_path"])), " ").alias("reached"))
        out = one if out is None else out.union(one)
    return out


_LEAVES = "(VALUES ('a.name', NULL, '$.a.name'), ('l.name', 0, '$.l[0].name'), ('l.name', 1, '$.l[1].name'), ('l.size', 0, '$.l[0].size'), ('l.size', 1, '$.l[1].size')) AS leaves(key, i, path)"
add("path_match", _paths, " UNION ALL ".join(f"SELECT p_partkey, '{p}' AS pattern, (SELECT coalesce(string_agg(path, ' ' ORDER BY path), '') FROM {_LEAVES} WHERE {c}) AS reached FROM part" for p, c in PATHS))
add(
    "min_confidence",
    lambda s, d: Guard(policy_of("mask", "PAN", min_confidence=0.7), SALT).scan(load(s, d, "customer").select("c_custkey", pan_text().alias("code")), columns=["code"]).select("c_custkey", "code", F.size("events").alias("n_events")),
    f"SELECT c_custkey, CASE WHEN k THEN '[MASKED:PAN]' ELSE code END AS code, CASE WHEN k THEN 1 ELSE 0 END AS n_events FROM (SELECT c_custkey, {PAN_SQL} AS code, {PAN_SQL}[4] IN ('A','B','C','F','G','H','L','J','P','T') AS k FROM customer)",
)


def _pinned(s: SparkSession, d: str) -> DataFrame:
    policy = parse_policy({"name": "pins", "defaults": {"unknown_entity_action": "allow"}, "rules": [{"id": "keep", "match": {"json_path": "$.who.n_name", "tool": "get_*"}, "action": "redact"}, {"id": "all", "match": {"json_path": "$..n_name"}, "action": "mask"}]})
    df = load(s, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("who"))
    return Guard(policy, SALT).scan(df, "get_nation", columns=["who"]).select("n_nationkey", F.col("who.n_name").alias("n_name"), F.col("who.n_regionkey").cast("string").alias("n_regionkey"), F.get("events", F.lit(0))["rule_id"].alias("rule_id"), F.get("events", F.lit(0))["json_path"].alias("json_path"))


add("pinned_rule", _pinned, "SELECT n_nationkey, '[REDACTED]' AS n_name, n_regionkey::VARCHAR AS n_regionkey, 'keep' AS rule_id, '$.who.n_name' AS json_path FROM nation")


def _withheld(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("a@b.co AKIA"), F.upper(F.translate(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16), "0123456789", "GHIJKLMNOP")), F.lit(" x@y.zz"))).otherwise("plain a@b.co")
    df = load(s, d, "customer").select("c_custkey", text.alias("note"))
    out = Guard(load_preset("strict"), SALT).scan(df, columns=["note"])
    return out.select("c_custkey", "note", F.col("guard.blocked").alias("blocked"), F.col("guard.rule_id").alias("rule_id"), F.col("guard.block_reason").alias("reason"), F.size("events").alias("n_events"))


add("result_block", _withheld, """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'plain [BLOCKED:strict/pii-block]' END AS note, c_custkey % 4 = 0 AS blocked, CASE WHEN c_custkey % 4 = 0 THEN 'secrets-kill' END AS rule_id,
CASE WHEN c_custkey % 4 = 0 THEN 'The result contained a credential and was withheld entirely.' END AS reason, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 1 END AS n_events FROM customer""")

# rewriting


def _clusters(s: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_linenumber") * 37 + F.col("l_partkey") % 40).cast("int")
    end = start + 5 + F.rint(F.col("l_quantity") * 2).cast("int")
    action = F.get(F.array(*map(F.lit, report.ACTIONS)), (F.col("l_suppkey") % 6).cast("int"))
    # of spans that start together, one without an end comes last, as in SQL
    span = F.struct(start.alias("start"), end.isNull().alias("open"), end.alias("end"), action.alias("action"))
    rows = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    f = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("E").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit(1).alias("tier"), F.lit("d").alias("detector"), x["action"].alias("action"), F.lit(None).cast("string").alias("rule_id")))
    return rows.select("l_orderkey", F.explode(clusters(f)).alias("c")).select("l_orderkey", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.col("c.action").alias("action"))


add("cluster_merge", _clusters, """
WITH f AS (SELECT l_orderkey, (l_linenumber * 37 + l_partkey % 40)::INT AS s, (l_linenumber * 37 + l_partkey % 40 + 5 + (l_quantity * 2)::INT)::INT AS e, l_suppkey % 6 AS v FROM lineitem WHERE l_suppkey % 6 > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_orderkey, min(s) AS span_start, max(e) AS span_end, ['allow', 'partial_mask', 'mask', 'tokenize', 'redact', 'block'][(max(v) + 1)::INT] AS action FROM g GROUP BY l_orderkey, k""")
add(
    "partial_mask_email",
    lambda s, d: load(s, d, "customer").select("c_custkey", partial_mask(F.concat(F.lower(F.col("c_mktsegment")), F.col("c_custkey").cast("string"), F.lit("@mail.example.org")), F.lit("EMAIL")).alias("masked")),
    "SELECT c_custkey, lower(c_mktsegment)[1] || '***@mail.example.org' AS masked FROM customer",
)
add(
    "partial_mask_last4",
    lambda s, d: load(s, d, "customer").select("c_custkey", partial_mask(F.concat(F.lit("+91 "), (F.col("c_custkey") + 9000000000).cast("string")), F.lit("PHONE")).alias("phone"), partial_mask(F.col("c_custkey").cast("string"), F.lit("BANK_ACCOUNT")).alias("account"), partial_mask(F.col("c_custkey").cast("string"), F.lit("DOB")).alias("other")),
    "SELECT c_custkey, '+** ******' || ((c_custkey + 9000000000)::VARCHAR)[7:10] AS phone, c_custkey::VARCHAR AS account, '[MASKED:DOB]' AS other FROM customer",
)


def _rewritten(action: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        text = F.concat(F.lit("to u"), F.col("c_custkey").cast("string"), F.lit("@ex.org and "), ifsc_text(), F.lit("."))
        return Guard(policy_of(action, "EMAIL", "IFSC"), SALT).scan(load(s, d, "customer").select("c_custkey", text.alias("note")), columns=["note"]).select("c_custkey", "note")

    return query


for _action, _one, _two in (("mask", "[MASKED:EMAIL]", "[MASKED:IFSC]"), ("redact", "[REDACTED]", "[REDACTED]"), ("block", "[BLOCKED:own/r1]", "[BLOCKED:own/r1]")):
    add(f"{_action}_text", _rewritten(_action), f"SELECT c_custkey, 'to {_one} and {_two}.' AS note FROM customer")
add(
    "numeric_leaf",
    lambda s, d: Guard(policy_of("mask", "PHONE"), SALT).scan(load(s, d, "customer").select("c_custkey", (F.col("c_custkey") * 7919 + 5999000000).alias("number"), "c_acctbal"), columns=["number", "c_acctbal"]).select("c_custkey", "number"),
    "SELECT c_custkey, CASE WHEN c_custkey * 7919 + 5999000000 >= 6000000000 THEN '[MASKED:PHONE]' ELSE (c_custkey * 7919 + 5999000000)::VARCHAR END AS number FROM customer",
)

# audit


def _audit_rows(s: SparkSession, d: str) -> DataFrame:
    policy = load_preset("dpdp")
    df = load(s, d, "customer").select("c_custkey", F.struct("c_name", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@ex.org")).alias("note")).alias("row"))
    out = Guard(policy, SALT).scan(df, "get_rows", columns=["row"])
    return audit_events(out, policy, "get_rows", "result", F.to_timestamp(F.lit(WHEN)), ["c_custkey"]).drop("ordinal", "ts")


_C = "SELECT c_custkey, 'dpdp' AS policy, 'get_rows' AS tool, 'result' AS direction, '{e}' AS entity_type, {t} AS tier, {c}::DOUBLE AS confidence, '{r}' AS rule_id, 'mask' AS action, '$.row.{p}' AS json_path, 0 AS span_start, length({v})::INT AS span_end, {h} AS value_hmac FROM customer"
_U = "('u' || c_custkey || '@ex.org')"
add("audit_events", _audit_rows, _C.format(e="PERSON_NAME", t=0, c=0.6, r="names-mask", p="c_name", v="c_name", h=HMAC_SQL.format(v="c_name")) + " UNION ALL " + _C.format(e="EMAIL", t=1, c=0.95, r="contact-mask", p="note", v=_U, h=HMAC_SQL.format(v=_U)))


def audit_table(s: SparkSession, d: str) -> DataFrame:
    """An audit table made from the events table."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    e = load(s, d, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), pick(["dpdp", "gdpr"], F.col("event_id") % 2).alias("policy"), F.concat(F.lit("tool"), (F.col("user_id") % 5).cast("string")).alias("tool"), pick(["request", "result"], F.col("event_id") % 2).alias("direction"),
        F.upper("event_type").alias("entity_type"), F.lit(1).alias("tier"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("rule_id"), pick(report.ACTIONS, F.col("event_id") % 6).alias("action"), F.lit("$").alias("json_path"),
        F.lit(0).alias("span_start"), F.lit(3).alias("span_end"), F.md5(F.col("event_id").cast("string")).alias("value_hmac"),
    )


AUDIT_SQL = "a AS (SELECT ts, CASE event_id % 2 WHEN 0 THEN 'dpdp' ELSE 'gdpr' END AS policy, 'tool' || user_id % 5 AS tool, upper(event_type) AS entity_type, ['allow', 'partial_mask', 'mask', 'tokenize', 'redact', 'block'][(event_id % 6 + 1)::INT] AS action FROM events)"
COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in report.ACTIONS)
SINCE, UNTIL = "2024-01-02", "2024-01-10T12:00:00"
add("audit_filter", lambda s, d: filter_audit(audit_table(s, d), SINCE, UNTIL, "gdpr").groupBy("tool", "action").agg(F.count("*").alias("n")), f"WITH {AUDIT_SQL} SELECT tool, action, count(*) AS n FROM a WHERE ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL.replace('T', ' ')}' AND policy = 'gdpr' GROUP BY ALL")
add("audit_by_entity_action", lambda s, d: report.entity_by_action(audit_table(s, d)), f"WITH {AUDIT_SQL} SELECT entity_type, count(*) AS events, {COUNTS} FROM a GROUP BY 1")
add("audit_by_action", lambda s, d: report.by_column(audit_table(s, d), "action"), f"WITH {AUDIT_SQL} SELECT action, count(*) AS events FROM a GROUP BY 1")
add("audit_by_tool", lambda s, d: report.by_column(audit_table(s, d), "tool"), f"WITH {AUDIT_SQL} SELECT tool, count(*) AS events FROM a GROUP BY 1")
_FORM = "yyyy-MM-dd HH:mm:ss"
add("audit_totals", lambda s, d: report.totals(audit_table(s, d)).select("total", F.date_format("first_ts", _FORM).alias("first_ts"), F.date_format("last_ts", _FORM).alias("last_ts")), "SELECT count(*) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events")
add("audit_summary", lambda s, d: report.summary(audit_table(s, d)).select("entity_type", "action", "tool", "events"), f"WITH {AUDIT_SQL} SELECT entity_type, action, tool, count(*) AS events FROM a GROUP BY GROUPING SETS ((entity_type, action), (action), (tool), ())")
add("audit_tail", lambda s, d: audit_table(s, d).select(report.tail_line().alias("line")), f"WITH {AUDIT_SQL}, b AS (SELECT *, ['request', 'result'][(event_id % 2 + 1)::INT] AS direction FROM (SELECT *, CASE policy WHEN 'dpdp' THEN 0 ELSE 1 END AS event_id FROM a)) SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '  ' || rpad(action, 12, ' ') || ' ' || rpad(entity_type, 16, ' ') || ' ' || rpad(tool, 24, ' ') || ' ' || rpad(direction, 8, ' ') || ' (default)' AS line FROM b")


def _written(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        at = f"{shared_path(s, 'audit')}{kind}"
        write_audit(audit_table(s, d), at)
        return report.entity_by_action(read_audit(s, at, policy="gdpr"))

    return query


for _name, _kind in (("audit_jsonl", ""), ("audit_parquet", ".parquet")):
    add(_name, _written(_kind), f"WITH {AUDIT_SQL} SELECT entity_type, count(*) AS events, {COUNTS} FROM a WHERE policy = 'gdpr' GROUP BY 1")

# tokens


def _vaulted(s: SparkSession, d: str) -> tuple[Vault, DataFrame]:
    vault = Vault(s, shared_path(s, "vault"), b"key")
    policy = policy_of("tokenize", "EMAIL")
    df = load(s, d, "orders").select("o_orderkey", F.concat(F.lit("from c"), (F.col("o_custkey") % 50).cast("string"), F.lit("@ex.org, twice: c"), (F.col("o_custkey") % 50).cast("string"), F.lit("@ex.org")).alias("note"))
    return vault, tokenize_rows(vault, Guard(policy, vault.salt), df, ["o_orderkey"], ["note"]).select("o_orderkey", "note")


def _tokenized(s: SparkSession, d: str) -> DataFrame:
    out = _vaulted(s, d)[1].select("o_orderkey", F.regexp_extract_all("note", F.lit(r"(\[EMAIL_[0-9]+\])"), 1).alias("t"))
    both = out.join(load(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("c")), "o_orderkey")
    return both.groupBy("c", F.array_join("t", " ").alias("tokens")).agg(F.count("*").alias("n"))


add("tokenize", _tokenized, """
SELECT c::VARCHAR AS c, '[EMAIL_' || k || '] [EMAIL_' || k || ']' AS tokens, n
FROM (SELECT o_custkey % 50 AS c, count(*) AS n, row_number() OVER (ORDER BY min(o_orderkey)) AS k FROM orders GROUP BY 1)""")


def _rehydrated(s: SparkSession, d: str) -> DataFrame:
    vault, out = _vaulted(s, d)
    return vault.rehydrate(out, ["o_orderkey"], "note")


add("token_rehydrate", _rehydrated, "SELECT o_orderkey, 'from c' || o_custkey % 50 || '@ex.org, twice: c' || o_custkey % 50 || '@ex.org' AS note FROM orders")


def _known(s: SparkSession, d: str) -> DataFrame:
    values = load(s, d, "nation").select(F.concat(F.lit("[PERSON_NAME_"), F.col("n_nationkey").cast("string"), F.lit("]")).alias("token"), F.col("n_name").alias("value"))
    df = load(s, d, "customer").select("c_custkey", F.concat(F.lit("x [PERSON_NAME_"), F.col("c_nationkey").cast("string"), F.lit("] y [PHONE_1]")).alias("note"))
    return rehydrate(df, ["c_custkey"], "note", values)


add("vault_lookup", _known, "SELECT c_custkey, 'x ' || n_name || ' y [PHONE_1]' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey")

# messages and payloads


def messages(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ordinal"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), digest(F.col("event_type")).alias("digest")).withColumn("ts", F.col("us") / 1e6).drop("us")


CONFIRM_SQL = """
WITH RECURSIVE m AS (SELECT user_id::VARCHAR AS session_id, event_id AS ordinal, epoch_us(ts) AS us, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT session_id, event_type, ordinal, k, us AS pending, 'block' AS decision FROM m WHERE k = 1
  UNION ALL SELECT session_id, event_type, m.ordinal, m.k, CASE WHEN pending IS NOT NULL AND us - pending <= 21600000000 THEN NULL ELSE us END, CASE WHEN pending IS NOT NULL AND us - pending <= 21600000000 THEN 'confirm' ELSE 'block' END
  FROM r JOIN m USING (session_id, event_type) WHERE m.k = r.k + 1)
SELECT session_id, ordinal, decision FROM r"""
add("confirm_resend", lambda s, d: confirm_batch(messages(s, d), window=3600 * 6), CONFIRM_SQL)


def _props(s: SparkSession, d: str) -> Column:
    return F.concat(F.lit('{"z": {"list": [1, "x@y.org", null]}, "a": '), F.col("props"), F.lit("}"))


def _walked(s: SparkSession, d: str) -> DataFrame:
    return json_leaves(load(s, d, "events").select("event_id", _props(s, d).alias("payload")), "payload", ["event_id"]).select("event_id", "ordinal", "path", "text")


add("json_walk", _walked, """
WITH t AS (SELECT event_id, unnest([{'o': 0, 'p': '$.z.list[0]', 't': '1'}, {'o': 1, 'p': '$.z.list[1]', 't': 'x@y.org'}, {'o': 2, 'p': '$.z.list[2]', 't': 'None'}, {'o': 3, 'p': '$.a.k', 't': json_extract_string(props, '$.k')}]) AS r FROM events)
SELECT event_id, r.o AS ordinal, r.p AS path, r.t AS text FROM t""")


def _json(s: SparkSession, d: str) -> DataFrame:
    df = load(s, d, "events").select("event_id", F.concat(F.lit('{"contact": "9876543210", "n": [1, "x@y.org"], "a": '), F.col("props"), F.lit("}")).alias("payload"))
    return scan_json(Guard(load_preset("ngo-default"), SALT), df, "payload").select("event_id", "payload", F.size("events").alias("n_events"))


add("json_scan", _json, """SELECT event_id, '{"contact": "******3210", "n": [1, "x***@y.org"], "a": ' || props || '}' AS payload, 3 AS n_events FROM events""")


def _decided(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("write u"), F.col("c_custkey").cast("string"), F.lit("@ex.org"))).otherwise(F.lit("hello"))
    out = Guard(load_preset("ngo-default"), SALT).scan_text(load(s, d, "customer").select("c_custkey", text.alias("prompt"), text.alias("raw")), "prompt")
    tool = F.when(F.col("c_custkey") % 2 == 0, "mail_send").otherwise("files_read")
    return out.select("c_custkey", F.col("prompt").alias("masked"), prompt_decision(F.col("guard")).alias("prompt"), tool_input_decision(F.col("guard"), tool, F.lit(False), "ask", ["files_*"]).alias("tool_input"), summary(F.col("events"), F.col("raw")).alias("summary"))


add("guard_decision", _decided, """
SELECT c_custkey, CASE WHEN k THEN 'write u***@ex.org' ELSE 'hello' END AS masked, CASE WHEN k THEN 'hold' END AS prompt, CASE WHEN k AND c_custkey % 2 = 0 THEN 'ask' END AS tool_input, CASE WHEN k THEN 'EMAIL (u***@ex.org)' ELSE '' END AS summary
FROM (SELECT *, c_custkey % 3 = 0 AS k FROM customer)""")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Customers' notes read as a stream and scanned; the same projection as in batch."""
    at = shared_path(s, "stream")
    load(s, d, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@ex.org")).alias("note")).write.parquet(f"{at}/in")
    source = s.readStream.schema("c_custkey long, note string").parquet(f"{at}/in")
    out = Guard(policy_of("partial_mask", "EMAIL"), SALT).scan(source, columns=["note"]).select("c_custkey", "note")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out")


add("stream_scan", _streamed, "SELECT c_custkey, 'u***@ex.org' AS note FROM customer")


def _stream_confirm(s: SparkSession, d: str) -> DataFrame:
    at = shared_path(s, "stream")
    messages(s, d).coalesce(1).write.parquet(f"{at}/in")
    source = s.readStream.schema("session_id string, ordinal long, digest string, ts double").parquet(f"{at}/in")
    rows = confirm_stream(source, window=3600 * 6, forget_hours=0)
    q = rows.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out")


add("stream_confirm", _stream_confirm, CONFIRM_SQL)
