"""Confirm by resend: a flagged message is held back until the same message comes again in time.

Of a session's flagged messages, one that was held less than ``window`` seconds
ago (both ends count) is confirmed and its entry used up; any other is blocked
and its digest kept with its time. A session keeps its ``most`` newest entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MOST = 300, 20
STATE = "map<string,double>"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def decide(pending: dict[str, float], what: str, now: float, window: int = WINDOW, most: int = MOST) -> tuple[str, dict[str, float]]:
    """The decision on a message, and the entries afterwards."""
    fresh = {k: t for k, t in pending.items() if now - t <= window}
    if fresh.pop(what, None) is not None:
        return "confirm", fresh
    fresh[what] = now
    return "block", dict(sorted(fresh.items(), key=lambda kv: kv[1])[-most:])


def confirm_batch(messages: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """session_id, ordinal, decision for flagged messages (session_id, ordinal, ts double, digest): a fold over each session in order."""
    entry = "array<struct<digest:string,ts:double>>"
    start = F.struct(F.array().cast(entry).alias("pending"), F.array().cast("array<struct<ordinal:long,decision:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        fresh = F.filter(acc["pending"], lambda p: m["ts"] - p["ts"] <= window)
        rest = F.filter(acc["pending"], lambda p: (m["ts"] - p["ts"] <= window) & (p["digest"] != m["digest"]))
        hit = F.exists(acc["pending"], lambda p: (m["ts"] - p["ts"] <= window) & (p["digest"] == m["digest"]))
        kept = F.concat(fresh, F.array(F.struct(m["digest"].alias("digest"), m["ts"].alias("ts"))))
        newest = F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), F.lit(most))
        decision = F.struct(m["ordinal"].alias("ordinal"), F.when(hit, "confirm").otherwise("block").alias("decision"))
        return F.struct(F.when(hit, rest).otherwise(newest).alias("pending"), F.concat(acc["out"], F.array(decision)).alias("out"))

    ordered = F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), F.col("ordinal").cast("long").alias("ordinal"), "digest")))
    folded = messages.groupBy("session_id").agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("session_id", F.explode("out").alias("o")).select("session_id", "o.ordinal", "o.decision")


def confirm_stream(messages: DataFrame, window: int = WINDOW, most: int = MOST, forget_hours: int = 24) -> DataFrame:
    """The same on a stream, with the entries of a session as its state.

    Sessions without messages for ``forget_hours`` are forgotten; 0 keeps them, which
    a run over what is available needs, since a waiting time keeps such a run going.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts", "ordinal"])
        out = []
        for ts, ordinal, what in zip(rows["ts"], rows["ordinal"], rows["digest"], strict=True):
            decision, pending = decide(pending, what, float(ts), window, most)
            out.append((key[0], int(ordinal), decision))
        state.update((list(pending), list(pending.values())))
        if forget_hours:
            state.setTimeoutDuration(forget_hours * 3600 * 1000)
        yield pd.DataFrame(out, columns=["session_id", "ordinal", "decision"])

    return messages.groupBy("session_id").applyInPandasWithState(run, "session_id string, ordinal long, decision string", "digests array<string>, times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_hours else GroupStateTimeout.NoTimeout)
