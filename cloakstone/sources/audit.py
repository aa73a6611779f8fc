"""Audit tables: where events go, and how they are read back.

A destination is a JSON-lines folder or file, a Parquet folder, an SQLite file,
or a PostgreSQL address; which, is told by its form.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import shared_path

COLUMNS = "ts timestamp, policy string, tool string, direction string, entity_type string, tier int, confidence double, rule_id string, action string, json_path string, span_start int, span_end int, value_hmac string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
FILE_COLUMNS = COLUMNS.replace("span_start", "start").replace("span_end", "end").replace("ts timestamp", "ts string")
ACTIONS = ("allow", "partial_mask", "mask", "tokenize", "redact", "block")
NEEDED = [n for n in NAMES if n != "rule_id"]
TABLE = "audit_events"


def backend_of(destination: str) -> str:
    if destination.startswith(("postgres://", "postgresql://")):
        return "postgres"
    if destination.endswith((".db", ".sqlite", ".sqlite3")):
        return "sqlite"
    return "parquet" if destination.rstrip("/").endswith(".parquet") else "jsonl"


def utc_text(ts: Column) -> Column:
    """A time as ISO text in UTC, to the microsecond, whatever the session's time zone."""
    plain = (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(ts) / F.lit(1000000).cast("decimal(20,0)")).cast("decimal(18,6)"))).cast("string")
    return F.concat(F.translate(F.substring(plain, 1, 19), " ", "T"), F.lit("."), F.rpad(F.substring(plain, 21, 6), 6, "0"), F.lit("+00:00"))


def utc_time(text: Column) -> Column:
    """A text as a time: UTC unless it names an offset; null where it isn't one."""
    day, offset = text.rlike(r"^\s*\d{4}-\d\d-\d\d\s*$"), text.rlike(r"(?i)(?:z|utc|[+-]\d\d:?\d\d)\s*$")
    return F.try_to_timestamp(F.when(day, F.concat(F.trim(text), F.lit("T00:00:00Z"))).when(offset, text).otherwise(F.concat(F.trim(text), F.lit("Z"))))


def jdbc_options(address: str) -> dict[str, str]:
    """JDBC options of an address like postgresql://user:password@host:5432/base?sslmode=require."""
    parts = urlsplit(address)
    where = parts.hostname or "localhost"
    where = f"[{where}]" if ":" in where else where
    url = f"jdbc:postgresql://{where}{f':{parts.port}' if parts.port else ''}{parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"
    own = {"user": parts.username, "password": parts.password}
    return {"url": url, "dbtable": TABLE, **{k: unquote(v) for k, v in own.items() if v is not None}}


def valid(events: DataFrame) -> DataFrame:
    """Events that hold what an event must: torn and foreign lines go."""
    good = F.col("action").isin(*ACTIONS) & F.col("direction").isin("request", "result")
    for name in NEEDED:
        good = good & F.col(name).isNotNull()
    return events.filter(good)


def read_audit(spark: SparkSession, source: str, since: str | None = None, until: str | None = None, policy: str | None = None) -> DataFrame:
    """Events of a source in the columns of an audit table, filtered; both ends of a time range count."""
    kind = backend_of(source)
    if kind == "jsonl":
        raw = spark.read.schema(f"{FILE_COLUMNS}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(source)
        named = raw.filter("_bad IS NULL").withColumn("ts", utc_time(F.col("ts"))).withColumnsRenamed({"start": "span_start", "end": "span_end"})
        events = valid(named.select(*NAMES))
    elif kind == "parquet":
        events = spark.read.parquet(source).select(*NAMES)
    elif kind == "sqlite":
        events = read_sqlite(spark, source)
    else:
        events = spark.read.format("jdbc").options(**jdbc_options(source)).load().withColumn("ts", utc_time(F.col("ts").cast("string"))).select(*NAMES)
    return filter_audit(events, since, until, policy)


def parse_when(when: str | Column) -> Column:
    """A time or a date (its first moment); UTC unless it says otherwise."""
    if not isinstance(when, str):
        return when
    found = datetime.fromisoformat(when)
    return F.lit(found if found.tzinfo else found.replace(tzinfo=timezone.utc))


def filter_audit(events: DataFrame, since: str | None = None, until: str | None = None, policy: str | None = None) -> DataFrame:
    if since is not None:
        events = events.filter(F.col("ts") >= parse_when(since))
    if until is not None:
        events = events.filter(F.col("ts") <= parse_when(until))
    return events if policy is None else events.filter(F.col("policy") == policy)


def write_audit(events: DataFrame, destination: str) -> None:
    """Appends events. Files are written in parallel; an SQLite file gets its rows through the driver, partition by partition."""
    kind = backend_of(destination)
    events = events.select(*NAMES)
    if kind == "parquet":
        events.withColumn("day", F.to_date(F.substring(utc_text(F.col("ts")), 1, 10))).write.mode("append").partitionBy("day").parquet(destination)
    elif kind == "jsonl":
        events.withColumn("ts", utc_text(F.col("ts"))).withColumnsRenamed({"span_start": "start", "span_end": "end"}).write.mode("append").json(destination)
    elif kind == "sqlite":
        write_sqlite(events.withColumn("ts", utc_text(F.col("ts"))).toLocalIterator(prefetchPartitions=True), destination)
    else:
        events.withColumn("ts", utc_text(F.col("ts"))).write.format("jdbc").mode("append").options(**jdbc_options(destination), stringtype="unspecified").save()


def write_sqlite(rows: Iterator, path: str) -> None:
    kinds = {"tier": "INTEGER", "span_start": "INTEGER", "span_end": "INTEGER", "confidence": "REAL"}
    with sqlite3.connect(path, timeout=5) as con:
        con.execute("PRAGMA journal_mode=WAL")
        con.execute(f"CREATE TABLE IF NOT EXISTS {TABLE} (id INTEGER PRIMARY KEY, {', '.join(f'{n} {kinds.get(n, "TEXT")}' for n in NAMES)})")
        for n in ("ts", "entity_type", "action", "tool"):
            con.execute(f"CREATE INDEX IF NOT EXISTS {TABLE}_{n} ON {TABLE} ({n})")
        con.executemany(f"INSERT INTO {TABLE} ({', '.join(NAMES)}) VALUES ({', '.join('?' * len(NAMES))})", rows)
    con.close()


def sqlite_rows(path: str, after: int, most: int) -> list[tuple]:
    """(id, event) of the next events of an SQLite file, by id."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return con.execute(f"SELECT id, {', '.join(NAMES)} FROM {TABLE} WHERE id > ? ORDER BY id LIMIT ?", (after, most)).fetchall()
    finally:
        con.close()


def read_sqlite(spark: SparkSession, path: str, at_once: int = 50_000) -> DataFrame:
    """An SQLite file's events. The file is on the driver, which hands it out ``at_once`` rows at a time through a stored table; keep large audits in Parquet."""
    kind = COLUMNS.replace("ts timestamp", "ts string")
    rows = sqlite_rows(path, 0, at_once)
    if len(rows) < at_once:
        return spark.createDataFrame([r[1:] for r in rows], kind).withColumn("ts", utc_time(F.col("ts")))
    at = shared_path(spark, "sqlite")
    while rows:
        spark.createDataFrame([r[1:] for r in rows], kind).write.mode("append").parquet(at)
        rows = sqlite_rows(path, rows[-1][0], at_once)
    return spark.read.schema(kind).parquet(at).withColumn("ts", utc_time(F.col("ts")))


def tail_sqlite(path: str, after: int | None = None, most: int = 1000) -> tuple[list[dict], int]:
    """(events after the cursor ``after``, the new cursor) of an SQLite file; without a cursor, none yet and that of its end."""
    if after is None:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            return [], con.execute(f"SELECT coalesce(max(id), 0) FROM {TABLE}").fetchone()[0]
        finally:
            con.close()
    rows = sqlite_rows(path, after, most)
    return [dict(zip(NAMES, r[1:], strict=True)) for r in rows], rows[-1][0] if rows else after


def tail_audit(spark: SparkSession, folder: str, from_start: bool = True) -> DataFrame:
    """A stream of the events of new files in a JSON-lines folder, those that are there first (or only files newer than now); torn and foreign lines are left out."""
    reader = spark.readStream.schema(FILE_COLUMNS)
    raw = (reader if from_start else reader.option("modifiedAfter", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")).json(folder)
    return valid(raw.withColumn("ts", utc_time(F.col("ts"))).withColumnsRenamed({"start": "span_start", "end": "span_end"}).select(*NAMES))
