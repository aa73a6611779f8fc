"""Quality rules: text statistics and perplexity bands by language.

The perplexity is that of an n-gram model with modified Kneser-Ney smoothing
over bytes (``ngram_model``), counted over all documents: every n-gram of
``order`` bytes is in it, rare ones too. Copies would vouch for each other, so
the model and the bands count each distinct text once, whatever the number of
its rows or the table's. Where more than ``held_texts`` texts are repeated, all
texts are brought together by a shuffle, else these alone. Results are the same.

A language's bands are its median of log10 perplexity a byte, less ``below``
and plus ``above`` robust deviations (1.4826 times the median absolute
deviation): what is much harder or much easier to predict than the language's
other texts is rejected, and no fixed share.

Where the model has more than ``held_grams`` n-grams it isn't broadcast: each
document's distinct n-grams are joined with it. Results are the same.

Defined cases: null text counts as no words; a document without words fails
the base rules; a null language is a language of its own; every language has
bands around its own median, and with fewer than ``least`` distinct texts that
pass the base rules a smaller deviation is drawn up toward that of all texts
from their languages' medians, in proportion (so a language's only text is
always within); repeated rows are each judged; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, drop_table, stored, table
from ._words import BLOCK, GOLD, SEPARATOR, Counter, Texts, U, Words, batch_of, blocks, mix, words_of
from .ngram_model import Level, byte_grams, held, kneser_ney

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANKS = " \t\n\x0b\x0c\r"
FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: log10 perplexities are counted in steps of this size for the bands.
STEP = 1 / 4096


def line_repeats(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_facts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    """The five statistics of each text."""
    data, at = texts
    n = len(at) - 1

    def by_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    repeat = np.zeros(n, np.int64)
    h, d = words.hash, words.doc
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            x = mix(mix(h[:-2] * GOLD + h[1:-1]) * GOLD + h[2:])
            key = mix(x + d[:-2].astype(U) * GOLD)
        at3 = np.flatnonzero(d[:-2] == d[2:])
        order = at3[np.argsort(key[at3], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[order[again] + k] = True
        repeat = np.bincount(d[covered], minlength=n)
    return {
        "n_words": np.bincount(d, minlength=n),
        "word_chars": by_text(~SEPARATOR[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": by_text(SYMBOLS[data]),
        "n_dup_lines": np.array([line_repeats(bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace")) for i in range(n)], np.int64),
        "n_repeat_words": repeat,
    }


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(code, n) of the rows (text) of ``docs``, counted in each partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(1_000_000)
        for _, texts in blocks(batches, limit=BLOCK // 8):
            for k, n in counter.add(byte_grams(texts, order)[0]):
                yield batch_of(code=k, n=n.astype(np.int64))
        for k, n in counter.rest():
            yield batch_of(code=k, n=n.astype(np.int64))

    return docs.select("text").mapInArrow(count, "code long, n long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """(text) of one row of each hash, brought together by a grouping that combines before it shuffles."""
    return docs.groupBy("hash").agg(F.first("text").alias("text")).select("text")


def fit(docs: DataFrame, order: int, held_texts: int = 1 << 20) -> list[DataFrame]:
    """The model of the distinct texts of ``docs`` (text, hash), as tables by order."""
    repeated = stored(docs.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated")
    n = repeated.count()
    if not n:
        grams = count_grams(docs, order)
    elif n > held_texts:
        grams = count_grams(one_of_each(docs), order)
    else:
        alone, copies = (docs.join(F.broadcast(repeated), "hash", how) for how in ("left_anti", "left_semi"))
        grams = count_grams(alone, order).union(count_grams(one_of_each(copies), order))
    return kneser_ney(grams.groupBy("code").agg(F.sum("n").alias("n")), order)


def score(docs: DataFrame, top: DataFrame, order: int, held_grams: int) -> DataFrame:
    """doc_id, lang, hash, the statistics, n_bytes, log10_p (sum over the bytes) for ``docs``, by the model's highest order."""
    if top.count() <= held_grams:
        shared = docs.sparkSession.sparkContext.broadcast(held(top))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Level = shared.value
            for batch, texts in blocks(batches, limit=BLOCK // 8):
                code, doc = byte_grams(texts, order)
                log10_p = np.bincount(doc, model.look_up(code), minlength=batch.num_rows)
                facts = base_facts(texts, words_of(texts))
                yield batch_of(**{c: batch.column(c) for c in ("doc_id", "lang", "hash")}, **{k: v.astype(np.int64) for k, v in facts.items()}, n_bytes=np.diff(texts.at), log10_p=log10_p)

        return docs.mapInArrow(scored, f"doc_id long, lang string, hash long, {FACTS}, n_bytes long, log10_p double")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=BLOCK // 8):
            code, doc = byte_grams(texts, order)
            by = np.lexsort((code, doc))
            code, doc = code[by], doc[by]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=batch.num_rows))]).astype(np.int32))
            facts = base_facts(texts, words_of(texts))
            yield batch_of(
                **{c: batch.column(c) for c in ("doc_id", "lang", "hash")},
                **{k: v.astype(np.int64) for k, v in facts.items()},
                n_bytes=np.diff(texts.at),
                codes=pa.ListArray.from_arrays(at, pa.array(code[first])),
                times=pa.ListArray.from_arrays(at, pa.array(np.diff(np.append(first, len(code))).astype(np.int64))),
            )

    found = docs.mapInArrow(listed, f"doc_id long, lang string, hash long, {FACTS}, n_bytes long, codes array<long>, times array<long>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "listed")
    each = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("c")).select("row", "c.codes", "c.times")
    sums = each.join(top.select(F.col("code").alias("codes"), F.log10("p").cast("float").alias("log10_p")), "codes").groupBy("row").agg(F.sum(F.col("times") * F.col("log10_p")).alias("log10_p"))
    return found.drop("codes", "times").join(sums, "row", "left").drop("row").withColumn("log10_p", F.coalesce("log10_p", F.lit(0.0)))


def median(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median of ``value`` by group, of rows (value, n)."""
    return counted.groupBy(*by).agg(F.percentile(value, 0.5, F.col("n")).alias("middle"), F.sum("n").alias("n"))


def bands(scored: DataFrame, below: float, above: float, least: int) -> DataFrame:
    """language, lower, upper for each language (prefixed by '=') with documents that pass the base rules.

    Each distinct text counts once. Texts are counted by language and step, so what is sorted by language is a few
    thousand rows, however many documents a language has.
    """
    steps = scored.filter(~F.col("base_failed")).groupBy("language", "hash").agg(F.round(F.min("log10_ppl") / STEP).cast("long").alias("step"))
    counted = stored(steps.groupBy("language", "step").agg(F.count("*").alias("n")), "steps")
    centre = stored(median(counted, ["language"], "step"), "centre")
    off = counted.join(centre.select("language", "middle"), "language").select("language", F.abs(F.col("step") - F.col("middle")).alias("off"), "n")
    pooled = median(off.groupBy("off").agg(F.sum("n").alias("n")), [], "off").first()["middle"] or 0.0
    own = F.least(F.col("n") / least, F.lit(1.0))
    spread = median(off, ["language"], "off").select("language", F.greatest(F.greatest("middle", own * F.col("middle") + (1 - own) * pooled) * STEP * 1.4826, F.lit(0.005)).alias("spread"))
    middle = F.col("middle") * STEP
    return centre.join(spread, "language").select("language", (middle - below * F.col("spread")).alias("lower"), (middle + above * F.col("spread")).alias("upper"))


def judge(docs: DataFrame, order: int = 6, below: float = 8.0, above: float = 3.5, least: int = 100, held_grams: int = 1 << 23) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, lang, the five statistics, base_failed, log10_ppl (a byte; null without words), lower, upper, kept."""
    docs = columns_of(docs, {"doc_id": "long", "text": "string", "lang": "string"}).withColumn("hash", F.xxhash64("text"))
    levels = fit(docs.select("text", "hash"), order)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stored(
        score(docs, levels[-1], order, held_grams).select(
            "*", failed.alias("base_failed"), F.when(F.col("n_words") > 0, -F.col("log10_p") / F.col("n_bytes")).alias("log10_ppl"), F.concat(F.lit("="), F.coalesce("lang", F.lit(""))).alias("language")
        ),
        "quality",
    )
    for level in levels:
        drop_table(level)
    found = stored(bands(scored, below, above, least), "bands")
    out = scored.join(found, "language", "left")
    # a language without bands has no document that passes the base rules
    lower, upper = F.coalesce("lower", F.lit(0.0)), F.coalesce("upper", F.lit(0.0))
    fits = F.coalesce(F.col("log10_ppl").between(lower, upper), F.lit(False))
    return out.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log10_ppl", lower.alias("lower"), upper.alias("upper"), (~F.col("base_failed") & fits).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lang")
