import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloakstone.operators import report
from cloakstone.operators.decisions import summary, tool_input_decision
from cloakstone.operators.json_scan import scan_json
from cloakstone.operators.rewrite import FINDING, clusters, partial_mask, rewrite
from cloakstone.operators.vault import Vault, label_of, tokenize_rows
from cloakstone.plans.guard import Guard, audit_events
from cloakstone.plans.paths import ANY_INDEX, PathError, demands, parse_path, path_fits, render_path
from cloakstone.plans.policy import PRESETS, PolicyError, load_policy, load_preset, parse_policy
from cloakstone.sources.audit import backend_of, read_audit, write_audit
from cloakstone.streaming.confirm import confirm_batch, decide

ACTIONS = report.ACTIONS


@pytest.mark.parametrize(("pattern", "path", "fits"), [("$.a.b", ("a", "b"), True), ("$.a", ("a", "b"), False), ("$..b", ("x", 0, "b"), True), ("$.a[0]", ("a", 0), True), ("$.a[0]", ("a", "0"), False), ("$.a[*].b", ("a", 7, "b"), True), ("$.*", (0,), False), ("$..*", ("a", 1, "c"), True), ("$..", ("a", 1), True)])
def test_paths(pattern, path, fits):
    assert path_fits(parse_path(pattern), path) is fits


def test_path_errors_and_symbols():
    for bad in ("a.b", "$", "$.नाम", "$[x]", "$.a b"):
        with pytest.raises(PathError):
            parse_path(bad)
    assert demands(parse_path("$.rows[3].a"), ("rows", ANY_INDEX, "a")) == {((0, 3),)}
    assert demands(parse_path("$..a"), ("rows", ANY_INDEX, "a")) == {()}
    assert render_path(("rows", 0, "a")) == "$.rows[0].a"


def test_policies(tmp_path):
    for name in PRESETS:
        assert load_preset(name).name == name
    with pytest.raises(PolicyError):
        load_preset("none")
    good = {"name": "p", "rules": [{"id": "a", "entities": ["EMAIL"], "action": "mask"}]}
    assert parse_policy({"policy": good}).resolve("EMAIL") == ("mask", parse_policy(good).rules[0])
    for bad in ({"id": "a", "action": "mask"}, {"id": "a", "entities": ["NONE"], "action": "mask"}, {"id": "a", "entities": ["EMAIL"], "action": "hide"}, {"id": "a", "entities": ["EMAIL"], "action": "mask", "scope": "result"}, {"id": "a", "match": {"json_path": "x"}, "action": "mask"}, {"id": "a", "entities": ["EMAIL"], "action": "mask", "more": 1}):
        with pytest.raises(PolicyError):
            parse_policy({"name": "p", "rules": [bad]})
    with pytest.raises(PolicyError):
        parse_policy({"name": "p", "rules": good["rules"] * 2})
    (tmp_path / "p.yaml").write_text("name: p\nrules:\n- {id: a, entities: [EMAIL], action: mask}\n")
    assert load_policy(tmp_path / "p.yaml").rules[0].id == "a"


def model(text, findings):
    """Clusters and the rewritten text, in plain Python."""
    out = []
    for f in sorted((f for f in findings if f[6] != "allow"), key=lambda f: f[0]):
        if out and f[0] < out[-1][1]:
            last = out[-1]
            lead = f if (ACTIONS.index(f[6]), f[3]) > (ACTIONS.index(last[2][6]), last[2][3]) else last[2]
            out[-1] = (last[0], max(last[1], f[1]), lead)
        else:
            out.append((f[0], f[1], f))
    for s, e, f in reversed(out):
        new = {"block": "[BLOCKED:p/default]", "redact": "[REDACTED]"}.get(f[6], f"[MASKED:{f[2]}]")
        text = text[:s] + new + text[e:]
    return [(s, e, f[6]) for s, e, f in out], text


def test_clusters_and_rewriting(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        text = "".join(rng.choice("aé😀ह b") for _ in range(rng.randint(1, 30)))
        found = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randrange(len(text))
            found.append((s, rng.randint(s + 1, len(text)), rng.choice("XYZ"), rng.choice([0.5, 0.9]), 1, "d", rng.choice(ACTIONS), None))
        rows.append((i, text, found))
    df = spark.createDataFrame(rows, f"i int, t string, f array<{FINDING}>")
    got = df.select("i", clusters(F.col("f")).alias("c"), "t").select("i", "c", rewrite(F.col("t"), F.col("c"), "p").alias("new")).collect()
    for r in got:
        merged, text = model(rows[r["i"]][1], rows[r["i"]][2])
        assert [(c["start"], c["end"], c["action"]) for c in r["c"]] == merged
        assert r["new"] == text


def test_partial_masks(spark):
    cases = [("asha@example.org", "EMAIL", "a***@example.org"), ("+91 98765 43210", "PHONE", "+** ***** *3210"), ("९८७६५४३२१०", "PHONE", "******३२१०"), ("Asha", "PHONE", "Asha"), ("x", "DOB", "[MASKED:DOB]"), ("@x", "EMAIL", "[MASKED:EMAIL]")]
    rows = spark.createDataFrame(cases, "v string, e string, want string").select("want", "v", partial_mask(F.col("v"), F.col("e")).alias("got"), partial_mask(F.col("v"), F.col("e"), strict=True).alias("strict")).collect()
    assert all(r["got"] == r["want"] for r in rows)
    assert rows[3]["strict"] == "[MASKED:PHONE]"


ROWS = [Row(id=201, name="Asha Devi", phone="+91 98765 43210", aadhaar="2345 6789 0124", note="mail a.b@x.org", n=234567890124, ok=True), Row(id=202, name=None, phone="", aadhaar=None, note="fine", n=7, ok=None)]
KIND = "id bigint, rows array<struct<id:bigint,name:string,phone:string,aadhaar:string,note:string,n:bigint,ok:boolean>>"


def test_nested_rows(spark):
    df = spark.createDataFrame([(1, ROWS), (2, None)], KIND)
    out = Guard(load_preset("ngo-default"), "salt").scan(df, "get", columns=["rows"]).orderBy("id").collect()
    first, second = out[0]["rows"]
    assert (first["name"], first["phone"], first["aadhaar"], first["note"], first["n"], first["ok"]) == ("[MASKED:PERSON_NAME]", "+** ***** *3210", "[BLOCKED:ngo-default/govt-financial-block]", "mail a***@x.org", "[BLOCKED:ngo-default/govt-financial-block]", True)
    assert (second["name"], second["phone"], second["note"], second["n"]) == (None, "", "fine", "7")
    events = {(e["json_path"], e["entity_type"], e["action"]) for e in out[0]["events"]}
    assert {("$.rows[0].name", "PERSON_NAME", "mask"), ("$.rows[0].phone", "PHONE", "partial_mask"), ("$.rows[0].aadhaar", "AADHAAR", "block"), ("$.rows[0].note", "EMAIL", "partial_mask")} <= events
    assert out[1]["rows"] is None and out[1]["events"] == []
    plan = Guard(load_preset("ngo-default"), "salt").scan(df, "get", columns=["rows"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_path_rules_and_withholding(spark):
    policy = parse_policy({"name": "p", "defaults": {"unknown_entity_action": "allow"}, "rules": [{"id": "second", "match": {"json_path": "$.rows[1].note"}, "action": "redact"}, {"id": "kill", "match": {"json_path": "$..id", "tool": "secret_*"}, "action": "block", "scope": "result"}]})
    df = spark.createDataFrame([(1, ROWS)], KIND)
    rows = Guard(policy, "s").scan(df, "open", columns=["rows"]).first()["rows"]
    assert (rows[0]["note"], rows[1]["note"]) == ("mail a.b@x.org", "[REDACTED]")
    held = Guard(policy, "s").scan(df, "secret_read", columns=["rows"]).first()
    assert held["rows"] is None and held["guard"]["blocked"] and held["guard"]["rule_id"] == "kill" and len(held["events"]) == 1


def test_json_payloads(spark):
    rows = [("{\"rows\": [{\"नाम\": \"लक्ष्मी\", \"फ़ोन\": \"९८७६५४३२१०\", \"n\": 1.0, \"x\": null}]}",), ("not json a@b.co",), ("{broken a@b.co",), (None,), ("",)]
    out = [r["p"] for r in scan_json(Guard(load_preset("ngo-default"), "s"), spark.createDataFrame(rows, "p string"), "p").collect()]
    assert out == ["{\"rows\": [{\"नाम\": \"[MASKED:PERSON_NAME]\", \"फ़ोन\": \"******३२१०\", \"n\": 1.0, \"x\": null}]}", "not json a***@b.co", "{broken a***@b.co", None, ""]


def test_audit_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "9876543210 10.0.0.1")], "id int, note string")
    policy = load_preset("dpdp")
    events = audit_events(Guard(policy, "s").scan(df, "t", columns=["note"]), policy, "t", "result", F.to_timestamp(F.lit("2024-05-01 12:00:00")))
    for end in ("a.jsonl", "a.parquet", "a.sqlite"):
        at = str(tmp_path / end)
        write_audit(events, at)
        back = read_audit(spark, at, since="2024-05-01T12:00:00", until="2024-05-01T12:00:00", policy="dpdp")
        assert sorted((r["entity_type"], r["action"], r["span_start"]) for r in back.collect()) == [("EMAIL", "mask", 0), ("IP_ADDRESS", "mask", 11), ("PHONE", "mask", 0)]
        assert read_audit(spark, at, since="2024-05-01T12:00:01").count() == 0
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "x.json").write_text('{"ts": "2024-05-01T12:00:00+00:00", "pol\n\n{"a": 1}\n')
    assert read_audit(spark, str(tmp_path / "torn")).count() == 0
    assert "3 events" in report.render(events, "here") and report.render(events.limit(0), "here").startswith("no audit events")
    assert backend_of("postgresql://x") == "postgres"


def test_vault(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v.parquet"), b"key")
    policy = parse_policy({"name": "p", "defaults": {"unknown_entity_action": "allow"}, "rules": [{"id": "t", "entities": ["EMAIL"], "action": "tokenize"}]})
    df = spark.createDataFrame([(1, "a@b.co and c@d.ee"), (2, "a@b.co"), (3, None), (4, "none [EMAIL_99]")], "id int, note string")
    out = tokenize_rows(vault, Guard(policy, vault.salt), df, ["id"], ["note"]).select("id", "note")
    rows = {r["id"]: r["note"] for r in out.collect()}
    assert rows[2] == rows[1].split(" and ")[0] and rows[1].count("[EMAIL_") == 2
    back = {r["id"]: r["note"] for r in vault.rehydrate(out, ["id"], "note").collect()}
    assert back == {1: "a@b.co and c@d.ee", 2: "a@b.co", 3: None, 4: "none [EMAIL_99]"}
    again = tokenize_rows(vault, Guard(policy, vault.salt), df, ["id"], ["note"])
    assert {r["id"]: r["note"] for r in again.collect()} == rows
    assert label_of("a b") == "A_B"
    with pytest.warns(UserWarning):
        masked = Guard(policy, "s").scan(df, columns=["note"]).filter("id = 2").first()
    assert masked["note"] == "[MASKED:EMAIL]" and masked["events"][0]["action"] == "mask"


def test_confirm(spark):
    rows = [("s", 0, 0.0, "a"), ("s", 1, 10.0, "a"), ("s", 2, 20.0, "a"), ("s", 3, 321.0, "a"), ("t", 4, 15.0, "a"), ("s", 5, 621.0, "a")]
    got = {r["ordinal"]: r["decision"] for r in confirm_batch(spark.createDataFrame(rows, "session_id string, ordinal long, ts double, digest string")).collect()}
    assert got == {0: "block", 1: "confirm", 2: "block", 3: "block", 4: "block", 5: "confirm"}
    pending = {}
    for i in range(25):
        _, pending = decide(pending, str(i), float(i))
    assert list(pending) == [str(i) for i in range(5, 25)]


def test_decisions(spark):
    out = Guard(load_preset("ngo-default"), "s").scan_text(spark.createDataFrame([("hi a@b.co",), ("hi",)], "p string").withColumn("raw", F.col("p")), "p")
    rows = out.select("p", summary(F.col("events"), F.col("raw")).alias("s"), tool_input_decision(F.col("guard"), F.lit("mail"), F.lit(True), "mask").alias("d"), tool_input_decision(F.col("guard"), F.lit("mail"), F.lit(True), "ask", ["ma*"]).alias("skip")).collect()
    assert [tuple(r) for r in rows] == [("hi a***@b.co", "EMAIL (a***@b.co)", "allow", None), ("hi", "", None, None)]
