"""Exact order statistics and percentiles of a column, without a task that holds all values.

A histogram by sign and binary exponent tells which range holds a rank; the range is cut into ``BINS`` equal parts and the part
that holds the rank again, until a part has one value or the rank is a part's first or last. Each step is an aggregation that is
combined before its shuffle and gives ``BINS`` rows a range at most, so the driver walks over counts alone. Both ways to deal
values out keep their order, so no value of another range can lie between two of one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _exponent(v: Column) -> Column:
    """A whole number that grows with v: its sign times its binary exponent, 0 for 0."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0))).cast("bigint") + 2000
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)


def _part(v: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * bins).cast("bigint"), F.lit(bins - 1).cast("bigint"))


def _histogram(values: DataFrame, ranges: Sequence[tuple[float, float]] | None, bins: int) -> dict[tuple[int, int], tuple[int, float, float]]:
    """(range, bin) to (count, least, greatest); without ranges the bins of all values by exponent."""
    if ranges is None:
        keyed = values.select("v", F.lit(0).alias("range"), _exponent(F.col("v")).alias("bin"))
    else:
        inside = [F.when(F.col("v").between(low, high), F.struct(F.lit(k).alias("range"), _part(F.col("v"), low, high, bins).alias("bin"))) for k, (low, high) in enumerate(ranges)]
        keyed = values.select("v", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("of")).select("v", "of.*")
    found = keyed.groupBy("range", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")).collect()
    return {(r["range"], r["bin"]): (r["n"], r["least"], r["greatest"]) for r in found}


def order_statistics(rows: DataFrame, value: Column, choose, bins: int = BINS) -> dict[int, float]:
    """The values at the ranks (from 0) that ``choose(n)`` names for n values; null and NaN do not count.

    ``rows`` are read once for each step, six times or so, so a stored table is best.
    """
    values = rows.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = _histogram(values, None, bins)
    n = sum(c for c, _, _ in counts.values())
    left = [(rank, rank, 0) for rank in sorted(set(choose(n)))]  # rank, rank within its range, range
    out: dict[int, float] = {}
    while left:
        following: list[tuple[int, int, tuple[float, float]]] = []
        for rank, inside, of in left:
            for (_, _), (count, least, greatest) in sorted(x for x in counts.items() if x[0][0] == of):
                if inside < count:
                    if inside == 0 or least == greatest:
                        out[rank] = least
                    elif inside == count - 1:
                        out[rank] = greatest
                    else:
                        following.append((rank, inside, (least, greatest)))
                    break
                inside -= count
        ranges = sorted({r for _, _, r in following})
        left = [(rank, inside, ranges.index(r)) for rank, inside, r in following]
        if left:
            counts = _histogram(values, ranges, bins)
    return out


def percentiles(rows: DataFrame, value: Column, fractions: Sequence[float], bins: int = BINS) -> list[float | None]:
    """The value at each share of the ranks, between two ranks in proportion; None without values."""
    total = 0

    def ranks(n: int) -> list[int]:
        nonlocal total
        total = n
        return [f(x * (n - 1)) for x in fractions for f in (floor, ceil)] if n else []

    found = order_statistics(rows, value, ranks, bins)
    if not total:
        return [None] * len(fractions)
    at = [x * (total - 1) for x in fractions]
    return [found[floor(p)] + (found[ceil(p)] - found[floor(p)]) * (p - floor(p)) for p in at]
