"""Reports on audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.sources.audit import utc_text

from .rewrite import ACTIONS


def entity_by_action(events: DataFrame) -> DataFrame:
    """entity_type, events, and a count for each action; most events first, then by name."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    return events.groupBy("entity_type").agg(F.count("*").alias("events"), *counts).orderBy(F.desc("events"), "entity_type")


def by_column(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("events")).orderBy(F.desc("events"), column)


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def summary(events: DataFrame) -> DataFrame:
    """All counts of a report in one pass: by entity and action, by action, by tool, in all (grouping tells which)."""
    from pyspark.sql.functions import col

    return events.groupingSets([[col("entity_type"), col("action")], [col("action")], [col("tool")], []], col("entity_type"), col("action"), col("tool")).agg(F.grouping_id().alias("grouping"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def render(events: DataFrame, source: str) -> str:
    """The report as text, from one pass. What reaches the driver is a row for each entity with an action, action and tool."""
    got = summary(events).withColumns({c: utc_text(F.col(c)) for c in ("first_ts", "last_ts")}).toPandas()
    whole = got[got["grouping"] == 7]
    if whole.empty or not whole["events"].iloc[0]:
        return f"no audit events found in {source}"
    cross = got[got["grouping"] == 1].pivot(index="entity_type", columns="action", values="events").fillna(0).astype(int)
    tables = {"ENTITY": cross.reindex(columns=[a for a in ACTIONS if a in cross]), "ACTION": got[got["grouping"] == 5].set_index("action")[[]], "TOOL": got[got["grouping"] == 6].set_index("tool")[[]]}
    counts = {"ENTITY": cross.sum(axis=1), "ACTION": got[got["grouping"] == 5].set_index("action")["events"], "TOOL": got[got["grouping"] == 6].set_index("tool")["events"]}
    span = " → ".join(whole[c].iloc[0][:16].replace("T", " ") for c in ("first_ts", "last_ts"))
    blocks = [f"audit report — {source}\n{whole['events'].iloc[0]} events · {span} UTC"]
    for title, table in tables.items():
        table.insert(0, "events", counts[title])
        table = table.sort_index().sort_values("events", ascending=False, kind="stable").rename(columns=str.upper).rename_axis(None)
        wide = max(map(len, [title, *table.index]))
        head, *lines = table.rename(index=lambda x, w=wide: x.ljust(w)).to_string().split("\n")
        blocks.append("\n".join([title + head[len(title) :], *lines]))
    return "\n\n".join(blocks)


def tail_line() -> Column:
    """An event as one line of a tail."""
    pad = lambda c, n: F.when(F.length(c) >= n, F.col(c)).otherwise(F.rpad(c, n, " "))
    return F.concat(F.concat(F.substring(utc_text(F.col("ts")), 1, 19), F.lit("Z")), F.lit("  "), pad("action", 12), F.lit(" "), pad("entity_type", 16), F.lit(" "), pad("tool", 24), F.lit(" "), pad("direction", 8), F.lit(" "), F.coalesce("rule_id", F.lit("(default)")))
