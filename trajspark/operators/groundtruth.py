"""Standardising recorded trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SPEED_UNITS, gt_vehicle_class, to_mps
from ..functions.quantiles import exact_percentiles
from ..functions.schema import GT_ALIASES, resolve
from .kinematics import A, T, V, VID, by_time, clipped_speed, step_back, upto


def consistent_speed(df: DataFrame, prefer: str = "speed", v0: float = 0.0, clip: bool = True) -> DataFrame:
    """Acceleration from speed, or speed from acceleration where a vehicle has no speed (or prefer is 'accel')."""
    w = by_time()
    per = Window.partitionBy(VID)
    has_v, has_a = F.count(V).over(per) > 0, F.count(A).over(per) > 0
    df = df.withColumn("_from_v", has_v & (~has_a | F.lit(prefer != "accel")))
    df = df.withColumn("_from_a", has_a & ~F.col("_from_v"))
    df = clipped_speed(df, v0, out="_v", clip=clip)
    first = F.row_number().over(w) == 1
    diff = F.coalesce((F.col(V) - F.lag(V).over(w)) / step_back(w), F.when(first, F.lit(0.0)))
    df = df.withColumn("_a", diff)
    return (
        df.withColumn(A, F.when(F.col("_from_v"), F.col("_a")).otherwise(F.col(A)))
        .withColumn(V, F.when(F.col("_from_a"), F.col("_v")).otherwise(F.col(V)))
        .drop("_from_v", "_from_a", "_a", "_v")
    )


def speed_odometer(df: DataFrame) -> DataFrame:
    """Running sum of v dt from 0."""
    w = by_time()
    df = df.withColumn("_inc", F.coalesce(F.col(V) * step_back(w), F.lit(0.0)))
    return df.withColumn("vehicle_odometer", F.sum("_inc").over(upto(w))).drop("_inc")


def standardise(df: DataFrame, unit: str = "m/s", prefer: str = "speed", keep_jerk: bool = False) -> DataFrame:
    """Recorded trajectories under standard names, in m/s, with class, acceleration and odometer."""
    rows = resolve(df, GT_ALIASES, paired=True, fold=True).where(F.col(T).isNotNull() & F.col(VID).isNotNull())
    rows = rows.withColumn(V, to_mps(F.col(V), unit)).withColumn("vehicle_type", gt_vehicle_class(F.col("vehicle_type")))
    if not keep_jerk:
        rows = rows.withColumn("vehicle_jerk", F.lit(None).cast("double"))
    no_odometer = rows.where("vehicle_odometer is not null").isEmpty()
    rows = consistent_speed(rows, prefer)
    return speed_odometer(rows) if no_odometer else rows


def speed_report(df: DataFrame, unit: str = "m/s") -> DataFrame:
    """(speed_p95, warning): 95th percentile of the speeds in m/s, and what makes the unit doubtful (null if nothing).

    df has its speeds in m/s, as `standardise` leaves them. Doubtful are an unknown unit, more than 60 m/s in a unit that
    is taken as m/s, and less than 10 m/s where km/h were converted.
    """
    name = unit.strip().lower()
    factor = SPEED_UNITS.get(name)
    p95 = F.col("speed_p95")
    warning = F.lit(None).cast("string") if factor else F.lit(f"unknown unit {unit}, taken as m/s")
    if factor in (None, 1.0):
        warning = F.concat_ws("; ", warning, F.when(p95 > 60, "p95 above 60 m/s: is the unit right?"))
    elif factor == SPEED_UNITS["km/h"]:
        warning = F.concat_ws("; ", warning, F.when(p95 < 10, "p95 below 10 m/s after conversion from km/h: is the unit right?"))
    (found,) = exact_percentiles(df, V, [0.95])
    speeds = df.sparkSession.range(1).select(F.lit(found).cast("double").alias("speed_p95"))
    return speeds.withColumn("warning", F.nullif(F.coalesce(warning, F.lit("")), F.lit("")))
