"""Dense numbers over a whole table without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_bounds(keys: DataFrame, column: str, per_range: int, sample_per_range: int = 32) -> list[str]:
    """Ascending ids that cut the distinct ids of keys into ranges of about per_range each.

    They come from a sample that a hash of the id decides, so reruns agree; the driver sees sample_per_range ids a range.
    """
    n = keys.count()
    ranges = -(-n // per_range)
    if ranges <= 1:
        return []
    every = max(1, n // (ranges * sample_per_range))
    sample = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(column), F.lit(every)) == 0).select(column).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def range_of(x: Column, bounds: list[str]) -> Column:
    """How many of the ascending bounds are at or before x, by halving."""
    return _halved(x, bounds, 0, len(bounds))


def _halved(x: Column, bounds: list[str], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x < F.lit(bounds[mid]), _halved(x, bounds, low, mid)).otherwise(_halved(x, bounds, mid + 1, high))


def sums_before(keys: DataFrame, column: str, amount: str, part: str) -> DataFrame:
    """(column, before): the sum of amount over all rows of a smaller key. part: the key's range; only ranges meet in one window."""
    ranges = keys.groupBy(part).agg(F.sum(amount).alias("_n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(part).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rows = keys.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(ranges, part)
    return rows.select(column, (F.col("_before") + F.col("_in")).alias("before"))


def dense_numbers(keys: DataFrame, column: str, per_range: int = 200_000) -> DataFrame:
    """(column, number): the distinct values in ascending order, numbered from 1."""
    distinct = keys.select(column).distinct()
    bounds = id_bounds(distinct, column, per_range)
    counted = distinct.select(column, F.lit(1).alias("_one"), range_of(F.col(column), bounds).alias("_range"))
    return sums_before(counted, column, "_one", "_range").select(column, (F.col("before") + 1).cast("long").alias("number"))
