"""Savitzky-Golay smoothing of trips as window expressions: no Python runs on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip
from .kinematics import T, V, VID, before, by_time, trapezoid_odometer, upto

KEYS = (VID, "trip_id")


def window_for(n: int, window: int = 11, order: int = 2) -> int:
    """Odd number of points to fit for a trip of n rows; 0: too short to smooth."""
    if n <= 2:
        return 0
    w = max(3, window + (window % 2 == 0))
    w = min(w, n if n % 2 else n - 1)
    if w < order + 2:
        w = order + 2 + (order % 2)  # the smallest odd number of at least order + 2
        return w if w <= n and w % 2 else 0
    return w


def coefficients(window: int, order: int) -> np.ndarray:
    """Row i: weights of the window's points for the fitted value at its point i."""
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def _fitted(v: str, n: Column, i: Column, ordered, window: int, order: int) -> Column:
    """Least-squares fit at row i of n: in the middle of its window, or off it near the ends.

    The values around a row come as one array, and its weights as a row of a table of all windows and places in them; so
    a row costs one dot product, whatever its place.
    """
    reach = window_for(10**6, window, order) - 1
    around = F.collect_list(v).over(ordered.rowsBetween(-reach, reach))
    sizes = {m: window_for(m, window, order) for m in range(1, reach + 2)}
    size = F.element_at(F.array(*[F.lit(sizes[m]) for m in sorted(sizes)]), F.least(n, F.lit(reach + 1)).cast("int"))
    half = F.floor(size / 2).cast("int")
    at = F.when(i < half, i).when(i >= n - half, i - n + size).otherwise(half).cast("int")
    known = sorted(set(sizes.values()) - {0})
    table, begin = [], {}
    for w in known:
        begin[w] = len(table)
        table += [[float(c) for c in row] for row in coefficients(w, order)]
    first = F.element_at(F.array(*[F.lit(begin.get(w, 0)) for w in range(max(known, default=0) + 1)]), size + 1)
    weights = F.element_at(F.lit(table), first + at + 1)
    values = F.slice(around, F.least(i, F.lit(reach)).cast("int") - at + 1, size)
    dot = F.aggregate(F.zip_with(values, weights, lambda x, c: x * c), F.lit(0.0), lambda total, x: total + x)
    return F.when(size > 0, dot).otherwise(F.col(v)) if known else F.col(v)


def _forward(v: str, ordered) -> Column:
    dt = F.lead(T).over(ordered) - F.col(T)
    return F.coalesce(F.when(dt > 0, (F.lead(v).over(ordered) - F.col(v)) / dt), F.lit(0.0))


def smooth_trips(
    df: DataFrame, window: int = 11, order: int = 2, v_max: float = 60.0, a_max: float = 10.0, eps: float = 1e-6, odo: str = "vehicle_odometer"
) -> DataFrame:
    """(time, vehicle_id, trip_id, speed, accel): smoothed speeds that keep stops at a trip's ends and its distance.

    Speeds are fitted, clipped and turned into accelerations by forward differences; those are clipped and summed up
    again. The inner speeds are then scaled so that the trip's distance is that of its odometer, and made consistent
    once more.
    """
    group = Window.partitionBy(*KEYS)
    ordered = by_time(*KEYS)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(T, *KEYS, F.coalesce(V, F.lit(0.0)).alias("_v"), F.col(odo).alias("_odo"))
    df = df.withColumns({"_n": F.count("*").over(group), "_i": F.row_number().over(ordered) - 1})
    df = df.withColumn("_s", clip(_fitted("_v", F.col("_n"), F.col("_i"), ordered, window, order), 0.0, v_max))
    end = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    df = df.withColumn("_s", F.when(end & (F.abs("_v") <= eps), F.lit(0.0)).otherwise(F.col("_s")))
    df = df.withColumn("_dt", F.greatest(F.coalesce(F.lead(T).over(ordered) - F.col(T), F.lit(0.0)), F.lit(0.0)))

    def consistent(df: DataFrame, speed: str) -> DataFrame:
        df = df.withColumn("_a", clip(_forward(speed, ordered), -a_max, a_max))
        df = df.withColumn("_ad", F.col("_a") * F.col("_dt"))
        summed = F.first(speed).over(upto(ordered)) + F.coalesce(F.sum("_ad").over(before(ordered)), F.lit(0.0))
        return df.withColumn("_r", clip(summed, 0.0, v_max))

    df = consistent(df, "_s")
    df = df.withColumn("_d", F.coalesce(0.5 * (F.col("_r") + F.lag("_r").over(ordered)) * F.lag("_dt").over(ordered), F.lit(0.0)))
    df = df.withColumn("_dist", F.sum("_d").over(group))
    df = df.withColumn("_span", F.last("_odo").over(whole) - F.first("_odo").over(whole))
    scales = (F.col("_span") > 0) & (F.col("_dist") > 1e-9) & (F.col("_n") > 2)
    df = df.withColumn("_scales", F.coalesce(F.col("_span") > 0, F.lit(False)))
    scaled = F.when(scales & ~end, F.col("_r") * F.col("_span") / F.col("_dist")).otherwise(F.col("_r"))
    df = df.withColumn("_a1", F.col("_a")).withColumn("_r1", F.col("_r")).withColumn("_z", clip(scaled, 0.0, v_max))
    df = consistent(df, "_z")
    return df.select(
        T,
        *KEYS,
        F.when(F.col("_scales"), F.col("_r")).otherwise(F.col("_r1")).alias("speed"),
        F.when(F.col("_scales"), F.col("_a")).otherwise(F.col("_a1")).alias("accel"),
    )


def with_odometer(smoothed: DataFrame) -> DataFrame:
    """The smoothed rows with jerk (forward difference of accel) and odometer (trapezoids from 0) of each vehicle."""
    df = smoothed.withColumn("jerk", _forward("accel", by_time(VID, ties=("trip_id",))))
    return trapezoid_odometer(df, (VID,), "speed", "odometer")
