"""From findings in a text to the rewritten text, as column expressions.

Findings that overlap form one cluster, which gets the action of its most
severe finding (then the surest, then the first). Allowed findings take no
part. Clusters are replaced from left to right in one fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakstone.functions.patterns import UNICODE, slice_text

ACTIONS = ("allow", "partial_mask", "mask", "tokenize", "redact", "block")
FINDING = "struct<start:int,end:int,entity_type:string,confidence:double,tier:int,detector:string,action:string,rule_id:string>"
CLUSTER = "struct<start:int,end:int,action:string,entity_type:string,rule_id:string,severity:int,confidence:double>"
#: Entities whose last four digits a partial mask leaves.
LAST_FOUR = ["PHONE", "AADHAAR", "CREDIT_CARD", "BANK_ACCOUNT", "GOVT_ID"]


def severity(action: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ACTIONS)), action) - 1).cast("int")


def clusters(findings: Column) -> Column:
    """array<CLUSTER>: merged overlaps; spans that only touch stay apart."""
    numbered = F.transform(findings, lambda f, i: F.struct(f["start"].alias("start"), i.alias("order"), f["end"].alias("end"), f["action"].alias("action"), f["entity_type"].alias("entity_type"), f["rule_id"].alias("rule_id"), severity(f["action"]).alias("severity"), f["confidence"].alias("confidence")))
    ordered = F.array_sort(F.filter(numbered, lambda f: f["severity"] > 0))

    def lead(a: Column, start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), *[a[c].alias(c) for c in ("action", "entity_type", "rule_id", "severity", "confidence")])

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(f["start"] < last["end"], F.lit(False))
        stronger = (f["severity"] > last["severity"]) | (f["severity"] == last["severity"]) & (f["confidence"] > last["confidence"])
        end = F.greatest(last["end"], f["end"])
        merged = F.when(stronger, lead(f, last["start"], end)).otherwise(lead(last, last["start"], end))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(lead(f, f["start"], f["end"]))))

    return F.aggregate(ordered, F.array().cast(f"array<{CLUSTER}>"), step)


def full_mask(entity: Column) -> Column:
    return F.concat(F.lit("[MASKED:"), entity, F.lit("]"))


def partial_mask(value: Column, entity: Column, strict: bool = False) -> Column:
    """A hint of the value: an address's first letter and domain, a number's last four digits.

    As it is, a number-like entity without more than four digits comes back
    unchanged, and an address value with a second address keeps that; with
    ``strict`` both are masked in full.
    """
    at = F.instr(value, "@")
    email = F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring(value, at + 1, F.length(value)))
    digits = F.regexp_replace(value, rf"{UNICODE}\d(?=(?:\D*\d){{4}})", "*")
    good_email = at > 1
    good_digits = F.lit(True)
    if strict:
        good_email = good_email & (F.length(value) - F.length(F.replace(value, F.lit("@"), F.lit(""))) == 1)
        good_digits = digits != value
    return F.when((entity == "EMAIL") & good_email, email).when(entity.isin(LAST_FOUR) & good_digits, digits).otherwise(full_mask(entity))


def replacement(value: Column, cluster: Column, policy: str, token: Column | None = None, strict: bool = False) -> Column:
    """What stands for a cluster's text. token: the vault's token for it, if there is a vault."""
    action, entity = cluster["action"], cluster["entity_type"]
    out = (
        F.when(action == "block", F.concat(F.lit(f"[BLOCKED:{policy}/"), F.coalesce(cluster["rule_id"], F.lit("default")), F.lit("]")))
        .when(action == "redact", F.lit("[REDACTED]"))
        .when(action == "partial_mask", partial_mask(value, entity, strict))
    )
    if token is not None:
        out = out.when(action == "tokenize", F.coalesce(token, full_mask(entity)))
    return out.otherwise(full_mask(entity))


def rewrite(text: Column, merged: Column, policy: str, token=None, strict: bool = False) -> Column:
    """The text with its clusters replaced. token(cluster, value) -> Column, with a vault."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        value = slice_text(text, c["start"], c["end"])
        new = replacement(value, c, policy, token(c, value) if token else None, strict)
        return F.struct(c["end"].alias("at"), F.concat(acc["out"], slice_text(text, acc["at"], c["start"]), new).alias("out"))

    return F.when(F.size(merged) == 0, text).otherwise(F.aggregate(merged, start, step, lambda acc: F.concat(acc["out"], slice_text(text, acc["at"], F.length(text)))))


def rewrite_whole(text: Column, findings: Column, policy: str, token=None, strict: bool = False) -> Column:
    """A value that can't be rewritten in parts: replaced whole by the action of its strongest finding, the first of equals."""
    ranked = F.transform(F.filter(findings, lambda f: f["action"] != "allow"), lambda f, i: F.struct(severity(f["action"]).alias("severity"), f["confidence"].alias("confidence"), (-i).alias("order"), f["action"].alias("action"), f["entity_type"].alias("entity_type"), f["rule_id"].alias("rule_id")))
    best = F.array_max(ranked)
    return F.when(F.size(ranked) == 0, text).otherwise(replacement(text, best, policy, token(best, text) if token else None, strict))
