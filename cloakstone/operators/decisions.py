"""Decisions on prompts and tool calls that were scanned, and summaries that don't repeat the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.functions.patterns import slice_text
from cloakstone.sources.steps import stored
from cloakstone.streaming.confirm import confirm_batch, digest

from .globs import tool_fits
from .rewrite import partial_mask


def summary(events: Column, text: Column | None = None) -> Column:
    """Each entity once, by name, with a preview of its first value where the payload is the text itself: ``EMAIL (l***@example.org), PHONE``."""
    acted = F.filter(events, lambda e: e["action"] != "allow")
    names = F.array_sort(F.array_distinct(F.transform(acted, lambda e: e["entity_type"])))

    def shown(name: Column) -> Column:
        first = F.get(F.filter(acted, lambda e: e["entity_type"] == name), F.lit(0))
        if text is None:
            return name
        preview = partial_mask(slice_text(text, first["start"], first["end"]), name)
        good = (first["json_path"] == "$") & ~F.startswith(preview, F.lit("[MASKED")) & (preview != "")
        return F.when(good, F.concat(name, F.lit(" ("), preview, F.lit(")"))).otherwise(name)

    return F.array_join(F.transform(names, shown), ", ")


def prompt_decision(guard: Column, mode: str = "confirm") -> Column:
    """off: null; warn: a warning; confirm: flagged prompts go on to confirm by resend."""
    if mode == "off":
        return F.lit(None).cast("string")
    return F.when(guard["modified"], F.lit("warn" if mode == "warn" else "hold"))


def guard_prompts(guard, messages: DataFrame, mode: str = "confirm", window: int = 300) -> DataFrame:
    """Prompts (session_id, ordinal, ts double, prompt) with decision, reason and the masked text.

    In the mode confirm a flagged prompt is blocked until the same text comes again within ``window``
    seconds, and then confirmed. decision: null (nothing found), warn, block or confirm.
    """
    taken = messages.select("session_id", "ordinal", "ts", "prompt", F.col("prompt").alias("_raw"))
    scanned = guard.scan_text(taken, "prompt").withColumn("held", prompt_decision(F.col("guard"), mode))
    shown = summary(F.col("events"), F.col("_raw"))
    if mode != "confirm":
        return scanned.select("session_id", "ordinal", F.col("held").alias("decision"), F.when(F.col("held").isNotNull(), shown).alias("reason"), F.col("prompt").alias("masked"))
    kept = stored(scanned.select("session_id", "ordinal", "ts", F.when(F.col("held").isNotNull(), digest(F.col("_raw"))).alias("digest"), shown.alias("shown"), F.col("prompt").alias("masked")), "prompts")
    decided = confirm_batch(kept.filter("digest IS NOT NULL").select("session_id", "ordinal", "ts", "digest"), window)
    decided = decided.select(F.col("session_id").alias("_session"), F.col("ordinal").alias("_ordinal"), "decision")
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("ordinal") == F.col("_ordinal"))
    return kept.join(decided, same, "left").select("session_id", "ordinal", "decision", F.when(F.col("decision").isNotNull(), F.col("shown")).alias("reason"), "masked")


def tool_input_decision(guard: Column, tool: Column, is_object: Column, mode: str = "ask", allowlist: Sequence[str] = ()) -> Column:
    """deny what is withheld; mask: allow objects with masked input; ask or mask: ask; warn: warn; null: nothing to say."""
    if mode == "off":
        return F.lit(None).cast("string")
    rest = F.lit("ask") if mode in ("ask", "mask") else F.lit("warn")
    out = F.when(guard["blocked"], "deny")
    if mode == "mask":
        out = out.when(is_object, "allow")
    return F.when(~tool_fits(tool, allowlist) & guard["modified"], out.otherwise(rest))


def tool_output_decision(guard: Column, mode: str = "warn") -> Column:
    return F.lit(None).cast("string") if mode == "off" else F.when(guard["modified"], "warn")
