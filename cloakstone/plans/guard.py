"""Scanning rows under a policy: one generated projection finds, decides, rewrites and records.

The schema is walked once, while the plan is built. Names of columns, path
rules, the choice of detectors and each entity's rule are settled there; what
is left for the rows are the detectors' patterns and the rewriting fold. A scan
has no shuffle and runs as it is on a stream.
"""

from __future__ import annotations

import os
import secrets
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakstone.functions.checks import hmac_sha256, normalize_digits, plain_number
from cloakstone.functions.patterns import slice_text
from cloakstone.operators import column_names
from cloakstone.operators.globs import tool_fits
from cloakstone.operators.detectors import DETECTORS, PatternDetector, no_spans, span
from cloakstone.operators.rewrite import clusters, rewrite, rewrite_whole

from .paths import ANY_INDEX, demands
from .policy import Policy, Rule

EVENT = "struct<entity_type:string,tier:int,confidence:double,rule_id:string,action:string,json_path:string,start:int,end:int,value_hmac:string,withholds:boolean,detector:string,value:string>"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_events() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def kept_salt(path: str | None = None) -> bytes:
    """The salt in the environment variable CLOAKSTONE_SALT, or else the one kept in a file, made at the first call."""
    from cloakstone.operators.vault import key_from

    if found := os.environ.get("CLOAKSTONE_SALT"):
        return found.encode()
    return key_from(path or os.path.expanduser("~/.cloakstone-salt"))


@dataclass
class Guard:
    """A policy made ready to scan.

    salt keys the hashes of found values; without one, a random one is drawn
    once for this guard, and hashes can't be compared with other guards'.
    extra_detectors: further objects with name, entity_type, tier and
    spans(text). extra_names: functions from a column's name to an entity or
    None. numeric_leaf: a number that is hit becomes a string ("string", so
    such columns are strings) or null ("null"). keep_values puts the found
    values into the events, for minting tokens; never store such events.
    """

    policy: Policy
    salt: str | bytes | None = None
    extra_detectors: Sequence = ()
    extra_names: Sequence[Callable[[str], str | None]] = ()
    numeric_leaf: str = "string"
    strict_partial: bool = False
    tokens: str | None = None
    """Name of a map<string,string> column from entity:hash to token (see the vault)."""
    keep_values: bool = False

    def __post_init__(self) -> None:
        if self.salt is None:
            self.salt = secrets.token_bytes(32)
            warnings.warn("no salt given: hashes of this guard can't be compared with others", stacklevel=3)
        covered = self.policy.covered()
        all_detectors: list[PatternDetector] = [*DETECTORS, *self.extra_detectors]
        self.detectors = [d for d in all_detectors if covered is None or d.entity_type in covered]
        self.covered = covered

    def effective(self, action: str) -> str:
        """Without a vault, tokens can't be had: the value is masked, and events say so."""
        if action == "tokenize" and self.tokens is None and not self.keep_values:
            warnings.warn(f"policy {self.policy.name!r} asks for tokens but there is no vault: masking instead", stacklevel=2)
            return "mask"
        return action

    # findings of one leaf

    def _findings(self, spans: Column, action: str, rule: Rule | None) -> Column:
        action = self.effective(action)
        withholds = rule is not None and rule.scope == "result" and rule.action == "block"
        return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "entity_type", "confidence", "tier", "detector")], F.lit(action).alias("action"), F.lit(rule.id if rule else None).cast("string").alias("rule_id"), F.lit(withholds).alias("withholds")))

    def _resolved(self, spans: Column, entity: str) -> Column:
        return self._findings(F.filter(spans, lambda s: s["confidence"] >= self.policy.defaults.min_confidence), *self.policy.resolve(entity))

    def _pinned(self, text: Column, tool: str | Column, path: tuple, indexes: list[Column]) -> Column | None:
        """The finding of the first path rule that fits."""
        whole = lambda: F.array(span(F.lit(0), F.length(text), "STRUCTURAL", F.lit(1.0), 0, "policy_match"))
        out: Column | None = None
        for rule in self.policy.path_rules(tool):
            found = demands(rule.match.steps, path)
            if not found:
                continue
            made = self._findings(whole(), rule.action, rule)
            by_row = None if isinstance(tool, str) or rule.match.tool == "*" else tool_fits(tool, [rule.match.tool])
            if () in found and by_row is None:
                return made if out is None else out.otherwise(made)
            fits = F.lit(() in found)
            for d in found:
                every = F.lit(True)
                for k, position in d:
                    every = every & (indexes[k] == position)
                fits = fits | every
            if by_row is not None:
                fits = fits & by_row
            out = F.when(fits, made) if out is None else out.when(fits, made)
        return None if out is None else F.coalesce(out, F.array().cast("array<struct<start:int,end:int,entity_type:string,confidence:double,tier:int,detector:string,action:string,rule_id:string,withholds:boolean>>"))

    def findings(self, text: Column, tool: str | Column = "", path: tuple = (), indexes: list[Column] | None = None, scannable: bool = True, key: Column | None = None, is_text: bool | Column = True) -> Column | None:
        """All findings of a leaf's text, in order; None if there can't be any. key: the name, where only the rows know it.

        is_text: whether the leaf is a string; detectors of tier 2 read only these.
        """
        parts: list[Column] = []
        pinned = self._pinned(text, tool, path, indexes or [])
        if pinned is not None:
            parts.append(pinned)
        if scannable:
            whole = lambda entity: F.when(text != "", F.array(span(F.lit(0), F.length(text), entity, F.lit(column_names.CONFIDENCE), 0, column_names.DETECTOR))).otherwise(no_spans())
            if key is not None:
                wanted = [e for e in sorted(column_names.ENTITIES) if self.covered is None or e in self.covered]
                if wanted:
                    named = lambda n: F.concat(*[self._resolved(F.when(n == e, whole(e)).otherwise(no_spans()), e) for e in wanted])
                    parts.append(let(column_names.entity_expression(key), named))
            else:
                name = next((s for s in reversed(path) if isinstance(s, str)), None)
                for tell in (column_names.entity_of, *self.extra_names) if name else ():
                    if (e := tell(name)) and (self.covered is None or e in self.covered):
                        parts.append(self._resolved(whole(e), e))
            detectors = [d for d in self.detectors if d.tier < 2 or is_text is not False]

            def spans(d: PatternDetector, t: Column) -> Column:
                return d.spans(t) if d.tier < 2 or is_text is True else F.when(is_text, d.spans(t)).otherwise(no_spans())

            if detectors:
                parts.append(let(normalize_digits(text), lambda t: F.concat(*[self._resolved(spans(d, t), d.entity_type) for d in detectors])))
        return F.concat(*parts) if parts else None

    def _looks(self, tool: str | Column, path: tuple, scannable: bool, key: Column | None, is_text: bool) -> bool:
        """Whether a leaf can have findings at all."""
        if any(demands(r.match.steps, path) for r in self.policy.path_rules(tool)):
            return True
        name = next((s for s in reversed(path) if isinstance(s, str)), None)
        told = key is not None or name and any((e := tell(name)) and (self.covered is None or e in self.covered) for tell in (column_names.entity_of, *self.extra_names))
        return scannable and bool(told or any(d.tier < 2 or is_text for d in self.detectors))

    def _events(self, findings: Column, text: Column, path: Column) -> Column:
        def one(f: Column) -> Column:
            value = slice_text(text, f["start"], f["end"])
            kept = value if self.keep_values else F.lit(None).cast("string")
            return F.struct(*[f[c].alias(c) for c in ("entity_type", "tier", "confidence", "rule_id", "action")], path.alias("json_path"), f["start"].alias("start"), f["end"].alias("end"), hmac_sha256(self.salt, value).alias("value_hmac"), f["withholds"].alias("withholds"), f["detector"].alias("detector"), kept.alias("value"))

        return F.transform(findings, one)

    def _token(self) -> Callable[[Column, Column], Column] | None:
        if self.tokens is None:
            return None
        return lambda c, value: F.try_element_at(F.col(self.tokens), F.concat(c["entity_type"], F.lit(":"), hmac_sha256(self.salt, value)))

    # the walk over a schema

    def _leaf(self, value: Column, kind: T.DataType, tool: str | Column, path: tuple, shown: Column, indexes: list[Column], key: Column | None) -> Column:
        is_text, is_number = isinstance(kind, T.StringType), isinstance(kind, NUMBERS)
        is_other = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType | T.DecimalType)
        keep = F.struct(value.alias("v"), no_events().alias("e"))
        if isinstance(kind, T.BinaryType):
            return keep
        text = value if is_text else plain_number(value.cast("double")) if isinstance(kind, T.FloatType | T.DoubleType) else value.cast("string")
        scannable = is_text or is_number or is_other
        text = F.coalesce(text, F.lit("None")) if not scannable else text
        if not self._looks(tool, path, scannable, key, is_text):
            return keep
        token = self._token()

        def done(f: Column, text: Column) -> Column:
            events = self._events(f, text if scannable else F.lit(""), shown)
            if is_text:
                new = let(clusters(f), lambda m: rewrite(value, m, self.policy.name, token, self.strict_partial))
            else:
                new = rewrite_whole(text, f, self.policy.name, token, self.strict_partial)
                if self.numeric_leaf == "null":
                    new = F.when(F.exists(f, lambda x: x["action"] != "allow"), F.lit(None).cast(kind)).otherwise(value)
                elif not scannable:
                    new = F.when(F.size(f) > 0, new).otherwise(value.cast("string"))
            return F.struct(new.alias("v"), events.alias("e"))

        # a number's text is an expression of its own, and is worked out once
        worked = lambda t: let(self.findings(t, tool, path, indexes, scannable, key, is_text), lambda f: done(f, t))
        if not scannable:
            return let(text, worked)
        made = worked(text) if is_text else let(text, worked)
        empty = F.lit(None).cast("string" if is_text or self.numeric_leaf != "null" else kind)
        return F.when(value.isNull(), F.struct(empty.alias("v"), no_events().alias("e"))).otherwise(made)

    def _walk(self, value: Column, kind: T.DataType, tool: str | Column, path: tuple, shown: Column, indexes: list[Column], key: Column | None = None) -> Column:
        """struct<v: the rewritten value, e: its events>."""
        if isinstance(kind, T.StructType):
            parts = [self._walk(value[f.name], f.dataType, tool, (*path, f.name), F.concat(shown, F.lit(f".{f.name}")), indexes) for f in kind.fields]

            def whole(s: Column) -> Column:
                new = F.struct(*[s[f"c{i}"]["v"].alias(f.name) for i, f in enumerate(kind.fields)])
                return F.struct(F.when(value.isNotNull(), new).alias("v"), F.when(value.isNotNull(), F.concat(*[s[f"c{i}"]["e"] for i in range(len(parts))])).otherwise(no_events()).alias("e"))

            return let(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), whole) if parts else F.struct(value.alias("v"), no_events().alias("e"))
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: self._walk(x, kind.elementType, tool, (*path, ANY_INDEX), F.concat(shown, F.lit("["), i.cast("string"), F.lit("]")), [*indexes, i], key))
            return let(each, lambda a: F.struct(F.transform(a, lambda x: x["v"]).alias("v"), F.coalesce(F.flatten(F.transform(a, lambda x: x["e"])), no_events()).alias("e")))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            # a map's keys are data: path rules see its entries as ".*"
            each = F.transform(F.map_entries(value), lambda x: F.struct(x["key"].alias("key"), self._walk(x["value"], kind.valueType, tool, (*path, "*"), F.concat(shown, F.lit("."), x["key"]), indexes, x["key"]).alias("w")))
            return let(each, lambda a: F.struct(F.map_from_entries(F.transform(a, lambda x: F.struct(x["key"], x["w"]["v"]))).alias("v"), F.coalesce(F.flatten(F.transform(a, lambda x: x["w"]["e"])), no_events()).alias("e")))
        return self._leaf(value, kind, tool, path, shown, indexes, key)

    def scan(self, df: DataFrame, tool: str | Column = "table", direction: str = "result", columns: Sequence[str] | None = None) -> DataFrame:
        """``df`` with the named columns (default: all) rewritten, and two more columns.

        guard: struct<blocked, block_reason, rule_id, modified>; events: array of EVENT. Where a rule
        withholds the whole result, the scanned columns are null and the events end with its finding.
        A null value gives no event. Rows stay as many and in place. tool: a name for all rows, or a column.
        """
        chosen = [c for c in df.columns if columns is None or c in columns]
        taken = {"guard", "events", "_found"} & set(df.columns)
        if taken:
            raise ValueError(f"rename the columns {sorted(taken)} first")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        made = {c: self._walk(F.col(f"`{c}`"), kinds[c], tool, (c,), F.lit(f"$.{c}"), []) for c in chosen}
        return self._finish(df, df.columns, made, direction)

    def scan_text(self, df: DataFrame, column: str, tool: str = "text", direction: str = "request") -> DataFrame:
        """The same for a column whose text is the whole payload: its path is ``$``, and its name tells nothing."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return self._finish(df, df.columns, {column: self._walk(F.col(f"`{column}`"), kinds[column], tool, (), F.lit("$"), [])}, direction)

    def _finish(self, df: DataFrame, columns: Sequence[str], made: dict[str, Column], direction: str) -> DataFrame:
        """``columns`` of ``df``, those in ``made`` (struct<v, e>) replaced, with guard and events.

        All of it is one expression, from the walk to the decision. A projection that reads the walk's result by
        several names would be merged with the walk by the optimizer, and the walk written out at each name.
        """
        reasons = {r.id: r.message or f"{direction} withheld by policy {self.policy.name!r} (rule {r.id!r})" for r in self.policy.rules if r.scope == "result"}

        def decided(s: Column, events: Column, first: Column) -> Column:
            blocked = first > 0
            rule = F.when(blocked, F.get(events, first - 1)["rule_id"])
            reason = F.lit(None).cast("string")
            for k, text in reasons.items():
                reason = F.when(rule == k, text).otherwise(reason)
            upto = F.when(blocked, F.slice(events, F.lit(1), F.greatest(first, F.lit(1)))).otherwise(events)
            modified = blocked | F.exists(events, lambda e: e["action"] != "allow")
            clean = [F.when(~blocked, s[f"c{i}"]["v"]).alias(f"c{i}") for i in range(len(made))]
            return F.struct(*clean, F.struct(blocked.alias("blocked"), reason.alias("block_reason"), rule.alias("rule_id"), modified.alias("modified")).alias("guard"), upto.alias("events"))

        def whole(s: Column) -> Column:
            events = F.concat(*[s[f"c{i}"]["e"] for i in range(len(made))]) if made else no_events()
            first = lambda e: F.array_position(F.transform(e, lambda x: x["withholds"]), F.lit(True)).cast("int")
            return let(events, lambda e: let(first(e), lambda n: decided(s, e, n)))

        parts = [m.alias(f"c{i}") for i, m in enumerate(made.values())] or [F.lit(None).alias("none")]
        found = df.select(*[F.col(f"`{c}`") for c in df.columns], let(F.struct(*parts), whole).alias("_found"))
        place = {c: i for i, c in enumerate(made)}
        clean = [F.col("_found")[f"c{place[c]}"].alias(c) if c in made else F.col(f"`{c}`") for c in columns]
        return found.select(*clean, F.col("_found")["guard"].alias("guard"), F.col("_found")["events"].alias("events"))


def audit_events(scanned: DataFrame, policy: Policy, tool: str | Column, direction: str, ts: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each event of scanned rows, ready for an audit table; ``keep`` names columns that stay with each."""
    e = F.col("_e")
    fields = ("entity_type", "tier", "confidence", "rule_id", "action", "json_path", "start", "end", "value_hmac")
    # of a column as it is, the optimizer would infer that it isn't null and not empty, and work the scan out for each
    needed = F.transform("events", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    name = F.lit(tool) if isinstance(tool, str) else tool
    rows = scanned.select(*[F.col(f"`{c}`") for c in keep], name.alias("_tool"), F.posexplode(needed).alias("ordinal", "_e"))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], "ordinal", (ts if ts is not None else F.current_timestamp()).alias("ts"), F.lit(policy.name).alias("policy"), F.col("_tool").alias("tool"), F.lit(direction).alias("direction"),
        e["entity_type"].alias("entity_type"), e["tier"].alias("tier"), e["confidence"].alias("confidence"), e["rule_id"].alias("rule_id"), e["action"].alias("action"), e["json_path"].alias("json_path"),
        e["start"].alias("span_start"), e["end"].alias("span_end"), e["value_hmac"].alias("value_hmac"),
    )
