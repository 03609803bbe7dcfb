"""Coordinates of one variant of a trajectory from another, along the odometer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kinematics import T, VID


def knots(reference: DataFrame, odo: str = "vehicle_odometer") -> DataFrame:
    """(vehicle_id, o, x, y): the reference's places in odometer order, the first of equal odometers."""
    rows = reference.where(F.col(odo).isNotNull() & F.col("vehicle_x").isNotNull() & F.col("vehicle_y").isNotNull())
    w = Window.partitionBy(VID).orderBy(odo, T)
    rows = rows.withColumn("_p", F.lag(odo).over(w)).where(f"_p is null or _p <> {odo}")
    return rows.select(VID, F.col(odo).alias("o"), F.col("vehicle_x").alias("x"), F.col("vehicle_y").alias("y"))


def fill_xy(df: DataFrame, reference: DataFrame, odo: str = "vehicle_odometer") -> DataFrame:
    """df with missing vehicle_x, vehicle_y interpolated between the reference's knots; held constant beyond them."""
    marks = knots(reference, odo).select(VID, F.col("o").alias("_o"), F.lit(0).alias("_row"), F.struct("o", "x", "y").alias("_k"))
    rows = df.withColumn("_o", F.col(odo)).withColumn("_row", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # knots stand before rows of the same odometer going up, and after them in the frame that looks ahead
    w = Window.partitionBy(VID).orderBy(F.col("_o").asc(), F.col("_row").asc())
    down = Window.partitionBy(VID).orderBy(F.col("_o").desc(), F.col("_row").asc())
    frame = (Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_a", F.last("_k", True).over(w.rowsBetween(*frame))).withColumn(
        "_b", F.last("_k", True).over(down.rowsBetween(*frame))
    )
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    share = F.when(b["o"] > a["o"], (F.col("_o") - a["o"]) / (b["o"] - a["o"])).otherwise(F.lit(0.0))
    out = both.where("_row = 1")
    for c in ("x", "y"):
        value = a[c] + (b[c] - a[c]) * share
        out = out.withColumn(f"vehicle_{c}", F.coalesce(f"vehicle_{c}", F.when(F.col("_o").isNotNull(), value)))
    return out.select(*df.columns)


def backfill_type(df: DataFrame, baseline: DataFrame, default: str = "sedan") -> DataFrame:
    """df with vehicle_type from the baseline's earliest row of the vehicle, where it is missing."""
    first = baseline.where("vehicle_type is not null").groupBy(VID).agg(
        F.min(F.struct(T, "vehicle_type"))["vehicle_type"].alias("_type")
    )
    return df.join(first, VID, "left").withColumn("vehicle_type", F.coalesce("vehicle_type", "_type", F.lit(default))).drop("_type")
