"""Speed, acceleration, jerk and distance of each vehicle, as window columns.

Every window has a total order (time, then the given tie columns), one shuffle by vehicle serves all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles, most_frequent

VID, T, V, A = "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_accel"


def by_time(*keys: str, ties: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*(keys or (VID,))).orderBy(T, *ties)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def step_back(w: WindowSpec) -> Column:
    """Seconds since the row before; null for the first and where time doesn't advance."""
    dt = F.col(T) - F.lag(T).over(w)
    return F.when(dt > 0, dt)


def backward_accel(df: DataFrame, out: str = A, w: WindowSpec | None = None) -> DataFrame:
    """Speed difference to the row before by time; 0 without one."""
    w = w or by_time()
    return df.withColumn(out, F.coalesce((F.col(V) - F.lag(V).over(w)) / step_back(w), F.lit(0.0)))


def odometer_integral(df: DataFrame, dt_first: float = 1.0, out: str = "vehicle_odometer") -> DataFrame:
    """Running sum of v dt + a dt^2 / 2 with the row's own v and a; the first row counts with dt_first."""
    w = by_time()
    dt = F.coalesce(step_back(w), F.lit(dt_first))
    df = df.withColumn("_inc", F.col(V) * dt + 0.5 * F.col(A) * dt * dt)
    return df.withColumn(out, F.sum("_inc").over(upto(w))).drop("_inc")


def trip_kinematics(df: DataFrame, ties: tuple[str, ...] = (), pos: str = "vehicle_pos") -> DataFrame:
    """Forward differences for steps of one second, distance, its sum before the row, and odometer from the first pos."""
    w = by_time(ties=ties)
    df = df.withColumn(A, F.coalesce(F.lead(V).over(w) - F.col(V), F.lit(0.0)))
    df = df.withColumn("vehicle_jerk", F.coalesce(F.lead(A).over(w) - F.col(A), F.lit(0.0)))
    df = df.withColumn("distance_m", F.col(V) + 0.5 * F.col(A))
    df = df.withColumn("cumulative_distance", F.coalesce(F.sum("distance_m").over(before(w)), F.lit(0.0)))
    first = F.first(pos).over(upto(w))
    return df.withColumn("vehicle_odometer", first + F.col("cumulative_distance"))


def trapezoid_odometer(df: DataFrame, keys: tuple[str, ...] = (VID,), v: str = V, out: str = "vehicle_odometer") -> DataFrame:
    w = by_time(*keys)
    inc = 0.5 * (F.col(v) + F.lag(v).over(w)) * F.coalesce(step_back(w), F.lit(0.0))
    df = df.withColumn("_inc", F.coalesce(inc, F.lit(0.0)))
    return df.withColumn(out, F.sum("_inc").over(upto(w))).drop("_inc")


def clipped_speed(df: DataFrame, v0: float = 0.0, a: str = A, out: str = V, clip: bool = True) -> DataFrame:
    """v = max(0, v + a dt) along the rows, from v0: the running sum less its lowest value below zero."""
    w = by_time()
    df = df.withColumn("_inc", F.coalesce(F.col(a) * step_back(w), F.lit(0.0)))
    df = df.withColumn("_sum", F.lit(float(v0)) + F.sum("_inc").over(upto(w)))
    low = F.least(F.lit(0.0), F.min("_sum").over(upto(w))) if clip else F.lit(0.0)
    return df.withColumn(out, F.col("_sum") - low).drop("_inc", "_sum")


def estimate_dt(df: DataFrame) -> DataFrame:
    """(n, median, mode, dt): usual positive step between rows of a vehicle; dt 1.0 without any.

    mode: of steps rounded to 6 digits, lowest on ties. dt is the mode if it agrees with the median, else the median.
    """
    steps = df.select(step_back(by_time()).alias("step")).where("step > 0")
    (median,) = exact_percentiles(steps, "step", [0.5])
    mode = most_frequent(steps, F.round("step", 6)).select(F.col("value").alias("mode"))
    found = steps.agg(F.count("step").alias("n")).withColumn("median", F.lit(median).cast("double"))
    found = found.join(mode, how="left", on=F.lit(True))
    dt = F.when(F.abs(F.col("mode") - F.col("median")) <= 1e-6, F.col("mode")).otherwise(F.col("median"))
    return found.withColumn("dt", F.coalesce(dt, F.lit(1.0)))


def accel_check(df: DataFrame, given: str, derived: str) -> DataFrame:
    """(mae, p95) of the given acceleration against the derived one."""
    gap = F.abs(F.col(given) - F.col(derived))
    (p95,) = exact_percentiles(df, gap, [0.95])
    return df.agg(F.avg(gap).alias("mae")).withColumn("p95", F.lit(p95).cast("double"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def moving_only(df: DataFrame, keys: tuple[str, ...] = (VID,)) -> DataFrame:
    """Rows of the groups with some speed other than 0."""
    moving = df.groupBy(*keys).agg(F.max(F.abs(V)).alias("_m")).where("_m > 0").drop("_m")
    return df.join(moving, list(keys), "left_semi")


def fill_missing_kinematics(df: DataFrame, dt: float, accel: bool, odometer: bool) -> DataFrame:
    """Forward-difference acceleration by a constant dt and trapezoid odometer, for columns that have no value at all."""
    w = by_time()
    if accel:
        df = df.withColumn(A, F.coalesce((F.lead(V).over(w) - F.col(V)) / F.lit(dt), F.lit(0.0)))
    return trapezoid_odometer(df) if odometer else df


def standardise_fcd(df: DataFrame, dt_first: float = 1.0) -> DataFrame:
    """Standard trajectories: acceleration derived if it has no value at all, else 0 in its gaps; odometer gaps integrated."""
    if df.where(F.col(A).isNotNull()).isEmpty():
        df = backward_accel(df)
    df = df.withColumn(A, F.coalesce(A, F.lit(0.0))).withColumn("_given", F.col("vehicle_odometer"))
    df = odometer_integral(df, dt_first)
    return df.withColumn("vehicle_odometer", F.coalesce("_given", "vehicle_odometer")).drop("_given")


def dt_report(df: DataFrame) -> DataFrame:
    """(dt_min, dt_median, dt_max, dt_nonpos_count): steps between a vehicle's rows; the first three of positive steps."""
    steps = df.select((F.col(T) - F.lag(T).over(by_time())).alias("dt"))
    (median,) = exact_percentiles(steps.where("dt > 0"), "dt", [0.5])
    up = F.when(F.col("dt") > 0, F.col("dt"))
    found = steps.agg(F.min(up).alias("dt_min"), F.max(up).alias("dt_max"), F.count_if(F.col("dt") <= 0).alias("dt_nonpos_count"))
    return found.withColumn("dt_median", F.lit(median).cast("double")).select("dt_min", "dt_median", "dt_max", "dt_nonpos_count")


def sample_vehicles(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All rows of n vehicles (all, if fewer), chosen by a hash of their ids and the seed; reruns agree."""
    chosen = df.where(F.col(VID).isNotNull()).select(VID).distinct().orderBy(F.xxhash64(F.lit(seed), VID), VID).limit(n)
    return df.join(chosen, VID, "left_semi")
