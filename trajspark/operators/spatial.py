"""Emissions along an axis, and their error against recorded trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kinematics import T, VID, by_time

TOLERANCE = 1e-9


def _masses(df: DataFrame, axis: str, rates: list[str]) -> DataFrame:
    """Metre cells lo..hi that a row crosses until the vehicle's next row, with the mass of each rate over that time."""
    w = by_time("data_type", VID)
    end, dur = F.lead(axis).over(w), F.lead(T).over(w) - F.col(T)
    rows = df.withColumn("_end", end).withColumn("_dur", dur).where(f"_dur > 0 and _end is not null and {axis} is not null")
    lo, hi = F.floor(F.least(axis, "_end")).cast("long"), F.floor(F.greatest(axis, "_end")).cast("long")
    mass = [(F.col(f"`{r}`") * F.col("_dur")).alias(f"{r.removesuffix('s')}") for r in rates]
    return rows.select("data_type", lo.alias("lo"), hi.alias("hi"), *mass)


def _summed(parts: DataFrame, axis: str, masses: list[str], size: float, origin: float) -> DataFrame:
    sums = parts.groupBy("data_type", "axis_bin").agg(*[F.coalesce(F.sum(f"`{m}`"), F.lit(0.0)).alias(m) for m in masses])
    start = F.lit(origin) + F.col("axis_bin") * size
    return sums.select(
        F.lit(axis).alias("axis"), "axis_bin", "data_type", *[F.col(f"`{m}`") for m in masses],
        start.alias("bin_start_m"), (start + size / 2).alias("bin_center_m"), (start + size).alias("bin_end_m"),
    )


def spatial_by_metre(df: DataFrame, axis: str, rates: list[str], size: float, origin: float) -> DataFrame:
    """A row's mass in equal parts over its metre cells, each cell in the bin that its start lies in."""
    masses = [r.removesuffix("s") for r in rates]
    rows = _masses(df, axis, rates)
    n = F.col("hi") - F.col("lo") + 1
    cells = rows.select("data_type", F.explode(F.sequence("lo", "hi")).alias("m"), *[(F.col(f"`{m}`") / n).alias(m) for m in masses])
    cells = cells.withColumn("axis_bin", F.floor((F.col("m") - origin) / size).cast("long"))
    return _summed(cells, axis, masses, size, origin)


def spatial_by_bin(df: DataFrame, axis: str, rates: list[str], size: float, origin: float) -> DataFrame:
    """The same result with a row for each bin that is crossed instead of each metre."""
    masses = [r.removesuffix("s") for r in rates]
    rows = _masses(df, axis, rates)
    first, last = (F.floor((F.col(c) - origin) / size).cast("long") for c in ("lo", "hi"))
    bins = rows.withColumn("axis_bin", F.explode(F.sequence(first, last)))
    left = F.ceil(F.lit(origin) + F.col("axis_bin") * size).cast("long")
    right = F.ceil(F.lit(origin) + (F.col("axis_bin") + 1) * size).cast("long") - 1
    inside = F.least("hi", right) - F.greatest("lo", left) + 1
    share = inside / (F.col("hi") - F.col("lo") + 1)
    parts = bins.where(inside > 0).select("data_type", "axis_bin", *[(F.col(f"`{m}`") * share).alias(m) for m in masses])
    return _summed(parts, axis, masses, size, origin)


def error_pct(spatial: DataFrame, masses: list[str], gt_tags: list[str]) -> DataFrame:
    """(axis_bin, data_type, gt_type, pollutant, value, gt_value, error_pct) for bins that both sides have."""
    long = spatial.select(
        "axis_bin",
        "data_type",
        F.inline(F.array(*[F.struct(F.lit(m.removesuffix("_g")).alias("pollutant"), F.col(f"`{m}`").alias("value")) for m in masses])),
    )
    is_gt = F.lower("data_type").isin(gt_tags)
    gt = long.where(is_gt).select("axis_bin", "pollutant", F.col("data_type").alias("gt_type"), F.col("value").alias("gt_value"))
    error = F.when(F.abs("gt_value") > TOLERANCE, (F.col("value") - F.col("gt_value")) / F.col("gt_value") * 100)
    return long.where(~is_gt).join(gt, ["axis_bin", "pollutant"]).withColumn("error_pct", error)


def compare_pivot(errors: DataFrame, types: list[str]) -> DataFrame:
    """(pollutant, axis_bin, one column for each data type): error by bin, against the first ground-truth type by name."""
    return errors.groupBy("pollutant", "axis_bin").pivot("data_type", types).agg(F.min_by("error_pct", "gt_type"))


def compare_summary(errors: DataFrame) -> DataFrame:
    """(pollutant, data_type, gt_type, n_bins, total, gt_total, mean_abs_error_pct, max_abs_error_pct)."""
    return errors.groupBy("pollutant", "data_type", "gt_type").agg(
        F.count("error_pct").alias("n_bins"), F.sum("value").alias("total"), F.sum("gt_value").alias("gt_total"),
        F.avg(F.abs("error_pct")).alias("mean_abs_error_pct"), F.max(F.abs("error_pct")).alias("max_abs_error_pct"),
    )


def top_cells(spatial: DataFrame, mass: str, k: int) -> DataFrame:
    """The k bins of largest mass, ties by bin and type."""
    return spatial.orderBy(F.col(f"`{mass}`").desc(), "axis_bin", "data_type").limit(k)


def time_between(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(T) >= low)
    return df.where(F.col(T) <= high) if high is not None else df
