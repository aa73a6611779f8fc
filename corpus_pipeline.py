"""From raw documents to token ids, stage by stage.

Stages decide by row, whatever its doc_id: a row's key is a hash of all its
columns, so rows with a null doc_id, or with one doc_id and different texts,
are documents of their own. Only near_dedup drops what is the same or linked.
Null texts are empty and fail the quality rules; texts of any length go whole
through every stage; columns other than those of documents are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.llm._cluster import stored, table
from cloakstone.llm.bpe_automaton import encode, vocabulary_path
from cloakstone.llm.near_dedup import near_duplicates
from cloakstone.llm.quality_rules import judge
from cloakstone.llm.source_mixing import mix

#: The share of the tokens before mixing that the mixed sample is drawn to.
MIX_SHARE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key made of all of a row: only rows that are the same in every column share one."""
    # a null and its place must count, which a hash of several columns alone passes over
    facts = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return docs.select(COLUMNS).withColumn("key", F.xxhash64(*facts))


def as_ids(rows: DataFrame) -> DataFrame:
    """The keyed rows as an operator's table, each under its key."""
    return rows.withColumn("doc_id", F.col("key")).drop("key")


def with_keys(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The keyed rows whose key is among the ``doc_id`` of ``keys``.

    The keys are stored first, so that their size is known when the join is planned: a table of up to
    spark.sql.autoBroadcastJoinThreshold is broadcast and no text is shuffled, a larger one is joined by shuffles.
    """
    return rows.join(stored(keys.select(F.col("doc_id").alias("key")), name), "key", "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    rows = keyed(docs)
    return with_keys(rows, judge(as_ids(rows)).filter("kept"), "passed").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id: five-word shingles, similarity of 0.8 or more."""
    rows = keyed(docs)
    groups = near_duplicates(as_ids(rows), percent=80, bands=36, rows=5).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", "doc_id")
    first = groups.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first"))
    kept = with_keys(rows, first.select(F.col("first.key").alias("doc_id")), "first")
    # rows that are the same in every column share a key; only these are brought together
    same = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "same")
    if not same.isEmpty():
        kept = kept.join(same, "key", "left_anti").unionByName(kept.join(same, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that brings sources, languages and topics to their target shares; a row is drawn by its key."""
    rows = keyed(docs)
    return with_keys(rows, mix(as_ids(rows), budget_share=MIX_SHARE).filter("selected"), "drawn").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary: little-endian unsigned 32-bit integers), whether decoding gives the text back."""
    path = vocabulary_path()
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"), "text")
    back = encode(rows, path, back=True)
    same = F.sha2(F.encode("text", "UTF-8"), 256) == F.col("sha256")
    return back.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("bpe", tokens),
]
#: Neither the language model nor the tokenizer can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
