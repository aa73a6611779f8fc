"""Copies of a text count once in the quality rules' model, however many rows there are."""

import math

import pytest
from pyspark.sql import functions as F

from cloakstone.llm import quality_rules


def texts(spark, n, copies):
    """``n`` texts, ``copies`` rows of each."""
    at = F.col("id") % n
    text = F.concat(F.lit("t"), F.translate(F.conv((at * 7919).cast("string"), 10, 7), "0123456", "abcdef "))
    return spark.range(n * copies).select(text.alias("text"), F.xxhash64(text).alias("hash"))


def model(levels):
    return {r["code"]: r["p"] for r in levels[-1].select("code", "p").collect()}


def test_two_rows_of_a_text_count_once_in_a_large_table(spark):
    # 140,000 rows: before, a text had to make up more than two of as many rows to count once
    once, twice = model(quality_rules.fit(texts(spark, 70_000, 1), 4)), model(quality_rules.fit(texts(spark, 70_000, 2), 4))
    assert once.keys() == twice.keys() and all(math.isclose(p, twice[k], rel_tol=1e-9) for k, p in once.items())


@pytest.mark.parametrize("held_texts", [1 << 20, 2, 0])
def test_many_repeated_texts_are_shuffled_with_the_same_results(spark, held_texts):
    rows = texts(spark, 50, 1).union(texts(spark, 3, 4)).union(spark.createDataFrame([(None, 42)] * 2, "text string, hash long"))
    got, want = model(quality_rules.fit(rows, 4, held_texts)), model(quality_rules.fit(texts(spark, 50, 1), 4))
    assert got.keys() == want.keys() and all(math.isclose(p, want[k], rel_tol=1e-9) for k, p in got.items())
