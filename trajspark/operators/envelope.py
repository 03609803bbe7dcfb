"""Jerk envelopes: which trips need a second refinement, and merging what it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kinematics import A, T, VID


def jerk_points(df: DataFrame, envelope: DataFrame, keys: tuple[str, ...] = (VID, "trip_id"), dt: float | None = None) -> DataFrame:
    """Rows with jerk (to the next row), the envelope of their acceleration, and inside (null envelope: outside).

    Steps are those to the row before (1 for the first, and for 0), or the constant dt.
    """
    w = Window.partitionBy(*keys).orderBy(T)
    back = F.coalesce(F.col(T) - F.lag(T).over(w), F.lit(1.0))
    step = F.lit(dt) if dt else F.when(back == 0, F.lit(1.0)).otherwise(back)
    rows = df.withColumn("jerk", (F.lead(A).over(w) - F.col(A)) / step)
    rows = rows.withColumn("accel_key", F.rint(F.col(A) * 10).cast("int"))
    bounds = envelope.select(F.col("accel_d10").alias("accel_key"), "jerk_min", "jerk_max")
    rows = rows.join(F.broadcast(bounds), "accel_key", "left")
    inside = (F.col("jerk") >= F.col("jerk_min")) & (F.col("jerk") <= F.col("jerk_max"))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(False)))


def bad_cases(points: DataFrame, least_pct: float = 90.0, keys: tuple[str, ...] = (VID, "trip_id")) -> DataFrame:
    """(keys, n_points, n_inside, pct) of the trips with three points or more of which too few are inside."""
    sums = points.where("jerk is not null").groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.count_if(F.col("inside")).alias("n_inside")
    )
    sums = sums.withColumn("pct", 100.0 * F.col("n_inside") / F.col("n_points"))
    return sums.where((F.col("n_points") >= 3) & (F.col("pct") < least_pct))


def strict_bad_cases(points: DataFrame, keys: tuple[str, ...] = (VID, "trip_id")) -> DataFrame:
    """(keys) of the trips with three rows or more where some row but the first and last is outside."""
    w = Window.partitionBy(*keys)
    rows = points.withColumn("_i", F.row_number().over(w.orderBy(T))).withColumn("_n", F.count("*").over(w))
    middle = rows.where("_n >= 3 and _i > 1 and _i < _n")
    return middle.groupBy(*keys).agg(F.every("inside").alias("ok")).where("not ok").drop("ok")


def overwrite(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str], together: bool = False) -> DataFrame:
    """base with the columns of new where those aren't null; together: only where none of them is."""
    side = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    both = base.join(side, keys, "left")
    given = [F.col(f"_{c}").isNotNull() for c in columns]
    every = given[0]
    for g in given[1:]:
        every = every & g
    values = {c: F.when(every if together else g, F.col(f"_{c}")).otherwise(F.col(c)) for c, g in zip(columns, given, strict=True)}
    return both.withColumns(values).select(*base.columns)
