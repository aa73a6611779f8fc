"""Modified Kneser-Ney n-gram models over bytes, counted by Spark and kept in sorted hash arrays.

A symbol is a byte plus one, or 0 for the start of a text; an n-gram is one
integer, ``BITS`` bits a symbol, the newest lowest (the hash is exact). Spark
counts the longest n-grams over all texts; of the lower orders, an n-gram's
count is the number of symbols seen before it, or, where it holds the start of
a text, how often it occurs. Every n-gram that was counted is in the model:
nothing is cut, whatever the size of the corpus.

The model is a table. No step of its making has a hot key: a history has at
most 256 followers, an n-gram at most 257 predecessors. ``held`` brings one
order to the driver as sorted arrays; ask its size first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import drop_table, stored
from ._words import Texts, look_up

BITS, SYMBOLS = 9, 256


class Level(NamedTuple):
    """Sorted n-grams of one order with log10 p(newest symbol | the others)."""

    gram: np.ndarray
    log10_p: np.ndarray

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """log10 p of n-grams that were counted; others are an error."""
        # in ascending order, so that the search walks through the arrays once
        order = np.argsort(codes)
        i, hit = look_up(self.gram, codes[order])
        if not hit.all():
            raise ValueError("an n-gram that wasn't counted")
        out = np.empty(len(codes), np.float32)
        out[order] = self.log10_p[i]
        return out


def byte_grams(texts: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) for each byte of the texts in order."""
    data, at = texts
    n = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    # before each text stand order - 1 zeros
    place = np.arange(len(data)) + (order - 1) * (doc + 1)
    padded = np.zeros(len(data) + (order - 1) * n, np.int64)
    padded[place] = data
    padded[place] += 1
    code = padded.copy()
    for k in range(1, order):
        code[k:] |= padded[:-k] << np.int64(BITS * k)
    return code[place], doc


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; usual values where these are too few."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(x, 0.05), i - 0.05)) for i, x in enumerate(d, 1))


def suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND((1 << (BITS * order)) - 1)


def kneser_ney(grams: DataFrame, order: int) -> list[DataFrame]:
    """Of each order from 1 on, a stored table (code long, p double, n long), from ``grams`` (code long, n long: distinct n-grams, counted)."""
    counts = [stored(grams.select("code", F.col("n").cast("long").alias("n")), f"grams{order}")]
    for k in range(order - 1, 0, -1):
        part = suffix(F.col("code"), k)
        at_start = F.shiftright(part, BITS * (k - 1)) == 0
        counts.insert(0, stored(counts[0].groupBy(part.alias("code")).agg(F.sum(F.when(at_start, F.col("n")).otherwise(1)).alias("n")), f"grams{k}"))
    levels: list[DataFrame] = []
    for k, counted in enumerate(counts, 1):
        facts = counted.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d = discounts({i: facts[f"n{i}"] for i in (1, 2, 3, 4)})
        own = F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        history = F.shiftright("code", BITS).alias("history")
        sums = counted.groupBy(history).agg(F.sum("n").alias("total"), F.sum(own).alias("kept"))
        rows = counted.select("code", "n", own.alias("own"), history, suffix(F.col("code"), k - 1).alias("shorter")).join(sums, "history")
        rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS)) if k == 1 else rows.join(levels[-1].select(F.col("code").alias("shorter"), F.col("p").alias("lower")), "shorter")
        levels.append(stored(rows.select("code", ((F.col("own") + (F.col("total") - F.col("kept")) * F.col("lower")) / F.col("total")).alias("p"), "n"), f"level{k}"))
        drop_table(counted)
    return levels


def held(level: DataFrame) -> Level:
    """One order as sorted arrays on the driver: 12 bytes an n-gram."""
    found = level.select("code", F.log10("p").cast("float").alias("log10_p")).toArrow()
    code = found.column("code").to_numpy()
    order = np.argsort(code)
    return Level(code[order], found.column("log10_p").to_numpy()[order])
