"""Scanning JSON texts whose shape only the rows know.

The walk over a payload needs its exact key order and number texts, so it runs
in Arrow batches: it lists the leaves (path, nearest key, text) and which path
rule holds for each. Finding, deciding and rewriting are the same column
expressions as for typed columns, over the array of leaves; then the payload is
put together again. A text that isn't JSON is one leaf, its path ``$``.

Defined cases: a payload nested deeper than ``DEEPEST`` levels can't be scanned
and is withheld, as one event of the action block; an escaped half of a
surrogate pair is read as U+FFFD, and stays as it was where its text isn't
changed; of a key that comes twice the last value counts; null stays null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cloakstone.plans.guard import EVENT, Guard, let
from cloakstone.plans.paths import path_fits, render_path

from .detectors import span
from .rewrite import clusters, rewrite, rewrite_whole

DEEPEST = 200
#: The rule number of a payload that can't be scanned.
UNREADABLE = -2
HALVES = re.compile("[\ud800-\udfff]")
LEAF = "struct<path:string,key:string,text:string,scannable:boolean,is_text:boolean,rule:int>"


class Unreadable(ValueError):
    """A payload that can't be scanned."""


def walk(node) -> Iterator[tuple[tuple, object]]:
    """(path, leaf) in document order."""
    waiting = [((), node)]
    while waiting:
        path, node = waiting.pop()
        if isinstance(node, dict | list):
            if len(path) >= DEEPEST:
                raise Unreadable
            below = node.items() if isinstance(node, dict) else enumerate(node)
            waiting += reversed([((*path, k), v) for k, v in below])
        else:
            yield path, node


def parse(text: str):
    """(payload, whether it is JSON): only objects and arrays count as JSON."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(text), True
        except RecursionError:
            raise Unreadable from None
        except ValueError:
            pass
    return text, False


def whole(text: str) -> str:
    """The text without halves of surrogate pairs, which have no UTF-8."""
    return HALVES.sub("\ufffd", text)


def with_column(df: DataFrame, name: str, kind: str, make) -> DataFrame:
    """``df`` with a further column, made batch by batch: make(record batch as lists by name) -> list."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(make(batch), arrow)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def with_leaves(df: DataFrame, column: str, rules: list[tuple[int, tuple]]) -> DataFrame:
    """``df`` with the leaves of its JSON column in ``_leaves``; rules: (number, path steps), the first that fits counts."""

    def listed(text: str | None) -> list[dict]:
        rows = []
        try:
            leaves = list(walk(parse(text)[0])) if text is not None else []
        except Unreadable:
            return [{"path": "$", "key": None, "text": "", "scannable": False, "is_text": True, "rule": UNREADABLE}]
        for path, value in leaves:
            is_text, plain = isinstance(value, str), not isinstance(value, bool)
            key = next((s for s in reversed(path) if isinstance(s, str)), None)
            rule = next((k for k, steps in rules if path_fits(steps, path)), -1)
            rows.append({"path": whole(render_path(path)), "key": key if key is None else whole(key), "text": whole(value) if is_text else str(value), "scannable": plain and isinstance(value, str | int | float), "is_text": is_text, "rule": rule})
        return rows

    return with_column(df, "_leaves", f"array<{LEAF}>", lambda batch: [listed(x) for x in batch.column(column).to_pylist()])


def rebuilt(texts: list, done: list) -> list:
    """The payloads with their changed leaves (in walk order) replaced; nothing else is touched."""

    def put(node, todo):
        if isinstance(node, dict):
            return {k: put(v, todo) for k, v in node.items()}
        if isinstance(node, list):
            return [put(v, todo) for v in node]
        flag, value = next(todo)
        return value if flag else node

    out = []
    for text, leaves in zip(texts, done, strict=True):
        if text is None or not any(x["hit"] for x in leaves):
            out.append(text)
            continue
        try:
            payload, is_json = parse(text)
            for _ in walk(payload):
                pass
        except Unreadable:  # withheld: the guard's error takes its place
            out.append(None)
            continue
        made = put(payload, iter([(x["hit"], x["new"]) for x in leaves]))
        out.append(HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(made, ensure_ascii=False)) if is_json else made)
    return out


def json_leaves(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row a leaf: keep, ordinal, path, key, text, is_text."""
    found = with_leaves(df.select(*keep, column), column, []).select(*keep, F.posexplode("_leaves").alias("ordinal", "leaf"))
    return found.select(*keep, "ordinal", "leaf.path", "leaf.key", "leaf.text", "leaf.is_text")


def scan_json(guard: Guard, df: DataFrame, column: str, tool: str = "json", direction: str = "result") -> DataFrame:
    """``df`` with the JSON column rewritten and the columns guard and events, as Guard.scan gives them.

    A withheld payload becomes an error object that names policy, rule and message.
    """
    rules = guard.policy.path_rules(tool)
    pins = [guard._findings(F.array(span(F.lit(0), F.lit(0), "STRUCTURAL", F.lit(1.0), 0, "policy_match")), r.action, r) for r in rules]
    listed = with_leaves(df, column, [(k, r.match.steps) for k, r in enumerate(rules)])
    token = guard._token()

    def one(leaf: Column) -> Column:
        found = guard.findings(leaf["text"], scannable=True, key=F.coalesce(leaf["key"], F.lit("")), is_text=leaf["is_text"])
        none = F.array().cast("array<struct<start:int,end:int,entity_type:string,confidence:double,tier:int,detector:string,action:string,rule_id:string,withholds:boolean>>")
        found = F.when(leaf["scannable"], found).otherwise(none) if found is not None else none
        for k, pin in enumerate(pins):
            whole = F.transform(pin, lambda f: F.struct(f["start"].alias("start"), F.length(leaf["text"]).alias("end"), *[f[c].alias(c) for c in ("entity_type", "confidence", "tier", "detector", "action", "rule_id", "withholds")]))
            found = F.when(leaf["rule"] == k, F.concat(whole, found)).otherwise(found)

        # fail closed: what can't be read isn't let through
        stop = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("STRUCTURAL").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit(0).alias("tier"), F.lit("unreadable").alias("detector"), F.lit("block").alias("action"), F.lit(None).cast("string").alias("rule_id"), F.lit(True).alias("withholds"))
        found = F.when(leaf["rule"] == UNREADABLE, F.array(stop)).otherwise(found)

        def done(f: Column) -> Column:
            events = guard._events(f, F.when(leaf["scannable"], leaf["text"]).otherwise(""), leaf["path"])
            hit = F.exists(f, lambda x: x["action"] != "allow")
            new = F.when(leaf["is_text"], let(clusters(f), lambda m: rewrite(leaf["text"], m, guard.policy.name, token, guard.strict_partial))).otherwise(rewrite_whole(leaf["text"], f, guard.policy.name, token, guard.strict_partial))
            return F.struct(hit.alias("hit"), new.alias("new"), events.alias("e"))

        return let(found, done)

    done = listed.withColumn("_done", F.transform("_leaves", one))
    events = F.coalesce(F.flatten(F.transform("_done", lambda d: d["e"])), F.array().cast(f"array<{EVENT}>"))
    out = guard._finish(done, [*df.columns, "_done"], {"_payload": F.struct(F.lit(None).cast("string").alias("v"), events.alias("e"))}, direction)
    out = with_column(out, "_new", "string", lambda batch: rebuilt(batch.column(column).to_pylist(), batch.column("_done").to_pylist()))
    error = F.to_json(F.struct(F.lit("blocked by policy").alias("error"), F.lit(guard.policy.name).alias("policy"), F.col("guard.rule_id").alias("rule"), F.coalesce("guard.block_reason", F.lit(f"{direction} withheld: it can't be scanned")).alias("message")))
    return out.withColumn(column, F.when(F.col("guard.blocked"), error).otherwise(F.col("_new"))).drop("_done", "_new")
