"""python -m cloakstone scan | report | rehydrate | lookup | tail | version

scan IN OUT --policy NAME_OR_FILE [--audit DEST] [--salt S] [--columns a,b] [--tool T]: rewrites a Parquet table.
report SOURCE [--since T] [--until T] [--policy NAME]: prints an audit report.
rehydrate IN OUT --vault PATH --key-file F --row-key a,b --column C: puts values back in place of tokens.
lookup TOKEN --vault PATH --key-file F: prints a token's value.
tail SOURCE [--from-start] [--seconds N]: prints new events of an SQLite file, or of a folder of JSON lines, as they come.

The salt is --salt, or CLOAKSTONE_SALT, or the one kept in --salt-file.
"""

from __future__ import annotations

import argparse
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, source: str, from_start: bool, seconds: float | None, pause: float = 0.5) -> None:
    """Prints events as they come, for so many seconds, or until it is stopped."""
    from cloakstone.operators.report import tail_line
    from cloakstone.sources.audit import COLUMNS, backend_of, tail_audit, tail_sqlite, utc_time

    show = lambda events: [print(r["line"], flush=True) for r in events.select(tail_line().alias("line")).toLocalIterator()]
    if backend_of(source) == "jsonl":
        lines = tail_audit(spark, source, from_start).writeStream.foreachBatch(lambda batch, _: show(batch) and None).start()
        lines.awaitTermination(seconds) if seconds is not None else lines.awaitTermination()
        lines.stop()
        return
    until = None if seconds is None else time.monotonic() + seconds
    cursor = 0 if from_start else tail_sqlite(source)[1]
    while until is None or time.monotonic() < until:
        events, cursor = tail_sqlite(source, cursor)
        if events:
            show(spark.createDataFrame([tuple(e.values()) for e in events], COLUMNS.replace("ts timestamp", "ts string")).withColumn("ts", utc_time(F.col("ts"))))
        else:
            time.sleep(pause)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cloakstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    scan, rep, back = sub.add_parser("scan"), sub.add_parser("report"), sub.add_parser("rehydrate")
    for s in (scan, back):
        s.add_argument("source")
        s.add_argument("target")
    scan.add_argument("--policy", required=True)
    scan.add_argument("--audit")
    scan.add_argument("--salt")
    scan.add_argument("--salt-file")
    scan.add_argument("--columns")
    scan.add_argument("--tool", default="table")
    rep.add_argument("source")
    for name in ("--since", "--until", "--policy"):
        rep.add_argument(name)
    for name in ("--vault", "--key-file", "--row-key", "--column"):
        back.add_argument(name, required=True)
    one = sub.add_parser("lookup")
    one.add_argument("token")
    for name in ("--vault", "--key-file"):
        one.add_argument(name, required=True)
    tail = sub.add_parser("tail")
    tail.add_argument("source")
    tail.add_argument("--from-start", action="store_true")
    tail.add_argument("--seconds", type=float)
    sub.add_parser("version")
    a = p.parse_args(args)
    if a.what == "version":
        from cloakstone import __version__

        print(__version__)
        return 0
    spark = SparkSession.builder.appName("cloakstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "scan":
        from cloakstone.operators.context import context_detectors
        from cloakstone.plans.guard import Guard, audit_events, kept_salt
        from cloakstone.plans.policy import PRESETS, load_policy, load_preset
        from cloakstone.sources.audit import write_audit

        policy = load_preset(a.policy) if a.policy in PRESETS else load_policy(a.policy)
        guard = Guard(policy, a.salt or kept_salt(a.salt_file), extra_detectors=context_detectors(policy))
        # one pass finds and rewrites; the events are read back from what it wrote
        guard.scan(spark.read.parquet(a.source), a.tool, columns=a.columns.split(",") if a.columns else None).write.parquet(a.target)
        if a.audit:
            write_audit(audit_events(spark.read.parquet(a.target), policy, a.tool, "result"), a.audit)
    elif a.what == "report":
        from cloakstone.operators.report import render
        from cloakstone.sources.audit import read_audit

        print(render(read_audit(spark, a.source, a.since, a.until, a.policy), a.source))
    elif a.what == "tail":
        follow(spark, a.source, a.from_start, a.seconds)
    elif a.what == "lookup":
        from cloakstone.operators.vault import Vault

        value = Vault(spark, a.vault, Path(a.key_file).read_bytes()).lookup(a.token)
        print(value if value is not None else f"unknown token {a.token}")
        return 0 if value is not None else 1
    else:
        from cloakstone.operators.vault import Vault

        vault = Vault(spark, a.vault, Path(a.key_file).read_bytes())
        vault.rehydrate(spark.read.parquet(a.source), a.row_key.split(","), a.column).write.parquet(a.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
