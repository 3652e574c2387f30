"""Exact quantiles without all values in one place: count by value range, then select inside the ranges that hold the wanted ranks."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a pass, and distinct values that the last one may bring to the driver.
RANGES, MOST = 256, 1 << 14


def _range(x: Column, edges: list[float], first: int = 0) -> Column:
    """The number of ``edges`` at or below x, by a tree of comparisons."""
    if not edges:
        return F.lit(first)
    k = len(edges) // 2
    return F.when(x < edges[k], _range(x, edges[:k], first)).otherwise(_range(x, edges[k + 1 :], first + k + 1))


def _at_ranks(values: DataFrame, ranks: list[int], n: int, ranges: int, most: int) -> dict[int, float]:
    """The values of the given ranks, from 0, of the column x of ``values``, which has n rows and no nulls."""
    if n <= most:
        found, seen = {}, 0
        for x, k in values.groupBy("x").agg(F.count("*").alias("k")).orderBy("x").collect():
            found |= {r: x for r in ranks if seen <= r < seen + k}
            seen += k
        return found
    shares = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(values.agg(F.percentile_approx("x", F.array(*map(F.lit, shares)), F.lit(100 * ranges)).alias("e")).first().e))
    counted = values.groupBy(_range(F.col("x"), edges).alias("range")).agg(F.count("*").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"))
    found, seen = {}, 0
    for _, k, low, high in sorted(counted.collect(), key=lambda r: r.range):  # one a range
        inside = [r for r in ranks if seen <= r < seen + k]
        if low == high:
            found |= dict.fromkeys(inside, low)
        elif inside:
            held = values.where(F.col("x").between(low, high))
            found |= {r + seen: x for r, x in _at_ranks(held, [r - seen for r in inside], k, ranges, most).items()}
        seen += k
    return found


def exact_quantiles(df: DataFrame, col: str, shares: list[float], ranges: int = RANGES, most: int = MOST) -> list[float] | None:
    """The quantiles of a numeric column at the given shares, interpolated between neighbouring ranks; None without values. Nulls do not count.

    A pass counts rows by range, ``ranges`` of about equal size by a sketch of the values; the sketch only places the edges, ranks are counted. Ranges that hold
    a wanted rank are split again until ``most`` rows are left or all are equal. So the driver sees counts and at most ``most`` values, no task
    holds more than its share, and each pass reads one range of those before it.
    """
    values = df.select(F.col(col).cast("double").alias("x")).where("x is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = values.count()
        if not n:
            return None
        places = [(n - 1) * q for q in shares]
        ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
        found = _at_ranks(values, ranks, n, ranges, most)

        def between(p: float) -> float:
            low, high = found[math.floor(p)], found[math.ceil(p)]
            return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

        return [between(p) for p in places]
    finally:
        values.unpersist()
