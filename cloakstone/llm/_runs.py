"""Dealing rows into runs of neighbouring ids, without a sort of the whole table.

The bounds are quantiles of the ids, found in one pass over that column; a
row's run is found by binary search in a constant array. There are at most
``most`` runs, whatever the table, so the array is small; the rows of a run
grow with the table only beyond ``rows * most`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def longs(values: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def place(column: str = "doc_id") -> Column:
    """The id by which rows are ordered: nulls first."""
    return F.coalesce(column, F.lit(LEAST))


def run_of(ids: DataFrame, at: str, rows: int, most: int) -> tuple[Column, int]:
    """(the run of a row whose id is in the column ``at``, one more than the largest run) for the table ``ids`` with that column."""
    n = max(0, min(most, ids.count() // rows) - 1)
    cuts = sorted(set(ids.agg(F.percentile_approx(at, [(i + 1) / (n + 1) for i in range(n)], 100 * (n + 1)).alias("q")).first()["q"] or [])) if n else []
    size = 1 << len(cuts).bit_length()
    bounds = longs(cuts + [(1 << 63) - 1] * (size - len(cuts)))
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())]) if size > 1 else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda a, s: a + F.when(F.get(bounds, a + s - 1) <= F.col(at), s).otherwise(0)), size
