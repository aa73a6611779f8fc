"""Plans that do each thing once, odd payloads, times in any session, tokens in nested rows, prompts from end to end."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from cloakstone.__main__ import main
from cloakstone.operators.context import context_detectors
from cloakstone.operators.decisions import guard_prompts
from cloakstone.operators.json_scan import scan_json
from cloakstone.operators.report import tail_line
from cloakstone.operators.vault import Vault, key_from, tokenize_rows
from cloakstone.plans.guard import Guard, audit_events, kept_salt
from cloakstone.plans.policy import load_preset, parse_policy
from cloakstone.plans.policy_queries import QUERIES, SQL
from cloakstone.sources.audit import filter_audit, jdbc_options, read_audit, tail_sqlite, utc_text, utc_time, write_audit

OPEN = {"name": "p", "defaults": {"unknown_entity_action": "allow"}}


def count(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_each_pattern_stands_once_for_each_leaf_in_the_optimized_plan(spark):
    policy = load_preset("dpdp")
    once = count(Guard(policy, "s").scan(spark.createDataFrame([("x",)], "note string"), columns=["note"]), "regexp_replace")
    assert once > 5
    rows = spark.range(3).select(F.struct(F.concat(F.lit("u"), F.col("id").cast("string")).alias("note"), F.lit("b").alias("more")).alias("row"), F.lit("c").alias("plain"))
    for columns, leaves in ((["row"], 2), (["row", "plain"], 3)):
        scanned = Guard(policy, "s").scan(rows, "t", columns=columns)
        assert count(scanned, "regexp_replace") == leaves * once
        assert count(audit_events(scanned, policy, "t", "result"), "regexp_replace") == leaves * once
    number = Guard(policy, "s").scan(spark.range(2).select((F.col("id") * 1.5).alias("n")), columns=["n"])
    assert count(number, "regexp_replace") <= 2 * once


def test_context_detectors_read_strings_only(spark):
    policy = load_preset("strict")
    guard = Guard(policy, "s", extra_detectors=context_detectors(policy))
    df = spark.createDataFrame([(234567890123, "no 234567890123")], "n bigint, t string")
    row = guard.scan(df).first()
    assert row["n"] == "234567890123" and "BLOCKED" in row["t"]
    made = scan_json(guard, spark.createDataFrame([('{"n": 234567890123, "t": "no 234567890123"}',)], "p string"), "p").first()["p"]
    assert json.loads(made)["n"] == 234567890123 and "BLOCKED" in json.loads(made)["t"]


def test_odd_payloads(spark):
    deep = '{"a":' * 5000 + '"x@y.org"' + "}" * 5000
    texts = ['{"a": "\\ud800 x@y.org", "b": "\\ud800"}', deep, '{"a": NaN, "b": 1e400, "c": {}, "d": []}', "[" * 100000, '{"k\\udfff": "x@y.org"}', "{}", '{"a": 1, "a": "x@y.org"}', "\x00"]
    rows = scan_json(Guard(load_preset("ngo-default"), "s"), spark.createDataFrame(list(enumerate(texts)), "i int, p string"), "p").orderBy("i").collect()
    out = [r["p"] for r in rows]
    assert json.loads(out[0]) == {"a": "� x***@y.org", "b": "\ud800"}
    assert json.loads(out[1])["error"] == "blocked by policy" and rows[1]["guard"]["blocked"] and [e["action"] for e in rows[1]["events"]] == ["block"]
    assert out[2] == texts[2] and out[5] == "{}" and out[7] == "\x00"
    assert "x@y.org" not in out[4] and "x@y.org" not in out[6] and not any("x@y.org" in p for p in out[1:2])
    assert scan_json(Guard(load_preset("ngo-default"), "s"), spark.createDataFrame([], "p string"), "p").count() == 0


def test_times_are_utc_in_any_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        texts = [("2024-05-01T12:00:00Z", "2024-05-01T12:00:00.000000+00:00"), ("2024-05-01 12:00:00.5", "2024-05-01T12:00:00.500000+00:00"), ("2024-05-01", "2024-05-01T00:00:00.000000+00:00"), ("2024-11-03T06:30:00.123456+01:00", "2024-11-03T05:30:00.123456+00:00"), ("2024-11-03T06:30:00Z", "2024-11-03T06:30:00.000000+00:00"), ("nothing", None)]
        got = spark.createDataFrame(texts, "t string, want string").select("want", utc_text(utc_time(F.col("t"))).alias("got")).collect()
        assert all(r["got"] == r["want"] for r in got)
        policy = load_preset("dpdp")
        df = spark.createDataFrame([("a@b.co",)], "note string")
        events = audit_events(Guard(policy, "s").scan(df), policy, "t", "result", utc_time(F.lit("2024-05-01T23:30:00Z")))
        for end in ("a", "a.parquet", "a.sqlite"):
            write_audit(events, str(tmp_path / end))
            back = read_audit(spark, str(tmp_path / end), since="2024-05-01T23:30:00", until="2024-05-01T23:30:00")
            assert back.select(utc_text(F.col("ts")).alias("t")).first()["t"] == "2024-05-01T23:30:00.000000+00:00"
            assert back.select(tail_line().alias("l")).first()["l"].startswith("2024-05-01T23:30:00Z ")
        assert json.loads("".join(p.read_text() for p in (tmp_path / "a").glob("*.json")))["ts"] == "2024-05-01T23:30:00.000000+00:00"
        assert [p.name for p in (tmp_path / "a.parquet").glob("day=*")] == ["day=2024-05-01"]
        assert filter_audit(events, since="2024-05-02").count() == 0 and filter_audit(events, since="2024-05-01T19:30:00-04:00").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tools_that_differ_by_row(spark):
    policy = parse_policy({**OPEN, "rules": [{"id": "one", "match": {"json_path": "$.note", "tool": "mail_*"}, "action": "redact"}, {"id": "all", "match": {"json_path": "$.note"}, "action": "mask"}]})
    df = spark.createDataFrame([("mail_send", "x"), ("read", "y"), (None, "z")], "tool string, note string")
    out = Guard(policy, "s").scan(df, F.col("tool"), columns=["note"])
    assert {r["tool"]: r["note"] for r in out.collect()} == {"mail_send": "[REDACTED]", "read": "[MASKED:STRUCTURAL]", None: "[MASKED:STRUCTURAL]"}
    assert {(r["tool"], r["rule_id"]) for r in audit_events(out, policy, F.col("tool"), "result").collect()} == {("mail_send", "one"), ("read", "all"), (None, "all")}


def test_tokens_in_nested_rows(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"), b"key")
    policy = parse_policy({**OPEN, "rules": [{"id": "t", "entities": ["EMAIL"], "action": "tokenize"}]})
    given = [(1, {"to": ["a@b.co", "none"], "cc": {"x": "a@b.co, c@d.ee"}}), (2, None), (3, {"to": None, "cc": {}})]
    df = spark.createDataFrame(given, "id int, mail struct<to:array<string>,cc:map<string,string>>")
    out = tokenize_rows(vault, Guard(policy, vault.salt), df, ["id"], ["mail"]).select("id", "mail")
    assert out.filter("id = 1").first()["mail"]["to"] == ["[EMAIL_1]", "none"]
    assert sorted(vault.rehydrate(out, ["id"], "mail").collect()) == sorted(df.collect())
    assert vault.lookup("[EMAIL_1]") == "a@b.co" and vault.lookup("[EMAIL_9]") is None and vault.lookup("EMAIL_1") is None
    assert Vault(spark, str(tmp_path / "v"), b"key", scope="other").lookup("[EMAIL_1]") is None
    twice = spark.createDataFrame([(1, "[EMAIL_1][EMAIL_1] [EMAIL_2]x[EMAIL_77]"), (2, "")], "id int, t string")
    assert [r["t"] for r in vault.rehydrate(twice, ["id"], "t").orderBy("id").collect()] == ["a@b.coa@b.co c@d.eex[EMAIL_77]", ""]


def test_keys_and_salts_are_kept(tmp_path, monkeypatch):
    at = str(tmp_path / "key")
    assert key_from(at) == key_from(at) and os.stat(at).st_mode & 0o777 == 0o600
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError):
        key_from(str(tmp_path / "empty"))
    monkeypatch.delenv("CLOAKSTONE_SALT", raising=False)
    assert kept_salt(str(tmp_path / "salt")) == kept_salt(str(tmp_path / "salt"))
    monkeypatch.setenv("CLOAKSTONE_SALT", "own")
    assert kept_salt() == b"own"


def test_prompts_from_end_to_end(spark):
    rows = [("s", 0, 0.0, "hi"), ("s", 1, 1.0, "write a@b.co"), ("s", 2, 5.0, "write a@b.co"), ("s", 3, 400.0, "write a@b.co"), ("t", 4, 2.0, "write a@b.co")]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, ts double, prompt string")
    guard = Guard(load_preset("ngo-default"), "s")
    got = {r["ordinal"]: (r["decision"], r["masked"]) for r in guard_prompts(guard, df).collect()}
    assert got == {0: (None, "hi"), 1: ("block", "write a***@b.co"), 2: ("confirm", "write a***@b.co"), 3: ("block", "write a***@b.co"), 4: ("block", "write a***@b.co")}
    warned = {r["ordinal"]: (r["decision"], r["reason"]) for r in guard_prompts(guard, df, "warn").collect()}
    assert warned[0] == (None, None) and warned[1] == ("warn", "EMAIL (a***@b.co)")


def test_addresses_and_tails(spark, tmp_path, capsys):
    assert jdbc_options("postgres://me:p%40ss@db.example.org:5433/audit?sslmode=require") == {"url": "jdbc:postgresql://db.example.org:5433/audit?sslmode=require", "dbtable": "audit_events", "user": "me", "password": "p@ss"}
    assert jdbc_options("postgresql://db/x") == {"url": "jdbc:postgresql://db/x", "dbtable": "audit_events"}
    policy, at = load_preset("dpdp"), str(tmp_path / "a.sqlite")
    events = audit_events(Guard(policy, "s").scan(spark.createDataFrame([("a@b.co",), ("c@d.ee",)], "note string")), policy, "t", "result", utc_time(F.lit("2024-05-01T12:00:00Z")))
    write_audit(events, at)
    assert tail_sqlite(at) == ([], 2)
    seen, cursor = tail_sqlite(at, 0, most=1)
    assert cursor == 1 and len(seen) == 1 and tail_sqlite(at, 2) == ([], 2)
    write_audit(events.limit(1), at)
    assert len(tail_sqlite(at, 2)[0]) == 1
    with sqlite3.connect(at) as con:
        assert con.execute("SELECT count(*) FROM audit_events").fetchone() == (3,)
    main(["version"])
    main(["tail", at, "--from-start", "--seconds", "2"])
    shown = capsys.readouterr().out.splitlines()
    assert shown[0] == "0.2.0" and [x[:20] for x in shown[1:]] == ["2024-05-01T12:00:00Z"] * 3
    from cloakstone.sources.audit import read_sqlite

    assert read_sqlite(spark, at, at_once=2).count() == 3


def lines(spark, at, rows):
    kind = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return sorted(map(tuple, QUERIES["cluster_merge"](spark, str(at)).collect()), key=str)


def test_clusters_of_odd_quantities_are_those_of_the_sql(spark, tmp_path):
    rows = [(1, 1, 1, 1, 1.3), (2, 1, 1, 1, 1.25), (3, 1, 1, 1, 0.75), (3, 8, 2, 1, 0.2), (4, 1, 1, 1, None), (5, 1, 1, 1, None), (5, 1, 2, 1, 5.0), (6, 1, 1, 1, 20.0), (6, 1, 2, 2, None), (6, 1, 3, 2, 30.0)]
    want = [(1, 38, 46, "partial_mask"), (2, 38, 45, "partial_mask"), (3, 38, 45, "partial_mask"), (3, 45, 50, "mask"), (4, 38, None, "partial_mask"), (5, 38, 53, "mask"), (6, 38, 140, "tokenize")]
    assert lines(spark, tmp_path, rows) == want
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert sorted(con.execute(SQL["cluster_merge"]).fetchall(), key=str) == want


def test_tied_spans_stay_in_one_cluster(spark, tmp_path):
    pair = [(1, 1, 1, 1, 5.0), (1, 1, 3, 1, 5.0)]
    for i, rows in enumerate((pair, pair[::-1])):
        assert lines(spark, tmp_path / str(i), [(1, 41, 2, 3, 1.0), *rows]) == [(1, 112, 119, "mask"), (1, 38, 53, "tokenize")]
