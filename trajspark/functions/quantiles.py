"""Exact percentiles and modes of a whole table, without gathering its values in one task.

The range of values is cut into bins, the rows in each are counted over the cluster, and only the bins in which a wanted
rank lies are cut again, until what is left has one value or few rows. A pass brings at most `bins` rows a rank to the
driver, whatever the number of rows; ranges shrink by that factor each time, so two or three passes are usual.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048
FEW = 20_000


def _values_at(values: DataFrame, ranks: list[int], low: float, high: float, n: int, bins: int, few: int) -> dict[int, float]:
    """{rank: value} for ranks (from 0) of the column x in ascending order; low, high: its bounds; n: its rows."""
    found: dict[int, float] = {}
    x = F.col("x")
    # open ranges: first and last value, rows before, rows inside, ranks wanted
    ranges = [(low, high, 0, n, ranks)]
    while ranges:
        found |= {k: low for low, high, _, _, wanted in ranges if low == high for k in wanted}
        parts, again = [r for r in ranges if r[0] < r[1]], []
        if not parts:
            break
        place = None
        for i, (low, high, _, inside, _) in enumerate(parts):
            # halves, as the width of a range may be more than the largest number
            share = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            cut = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("long")
            own = F.struct(F.lit(i).alias("i"), cut.alias("bin"), F.when(F.lit(inside <= few), x).alias("value"))
            held = x.between(low, high)
            place = F.when(held, own) if place is None else place.when(held, own)
        counted = (
            values.select(x, place.alias("p")).where("p is not null")
            .groupBy("p.i", "p.bin", "p.value").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        )
        for i, (_, _, before, _, wanted) in enumerate(parts):
            for r in sorted((r for r in counted if r.i == i), key=lambda r: r.low):
                inner = [k for k in wanted if before <= k < before + r.n]
                if inner:
                    again.append((r.low, r.high, before, r.n, inner))
                before += r.n
        ranges = again
    return found


def exact_percentiles(df: DataFrame, column: str | Column, shares: list[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """Percentiles with linear interpolation between neighbouring ranks, as Spark's `percentile` has them; None without values.

    Nulls, NaN and infinite values don't count. The values are kept on disk while it runs, and computed once.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = df.select(x.alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    values = values.persist(StorageLevel.DISK_ONLY)
    try:
        n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
        if not n:
            return [None] * len(shares)
        at = [s * (n - 1) for s in shares]
        ranks = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
        found = _values_at(values, ranks, low, high, n, bins, few)
        out = []
        for a in at:
            lower, upper = math.floor(a), math.ceil(a)
            out.append(found[lower] if lower == upper else (upper - a) * found[lower] + (a - lower) * found[upper])
        return out
    finally:
        values.unpersist()


def most_frequent(df: DataFrame, column: str | Column) -> DataFrame:
    """(value, count): the value that most rows have, the lowest of several; no row without values."""
    value = F.col(column) if isinstance(column, str) else column
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").count()
    return counts.orderBy(F.desc("count"), "value").limit(1)
