"""Trips: driving phases between stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import id_bounds, range_of, sums_before
from .kinematics import T, V, VID, by_time, trip_kinematics, upto


def stop_islands(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """seg: number of the row's run of stopped or driving rows, from 1 in each vehicle. zero: the row is stopped."""
    w = by_time()
    df = df.withColumn("zero", F.col(V) <= eps if eps > 0 else F.col(V) == 0)
    change = F.coalesce((F.col("zero") != F.lag("zero").over(w)).cast("int"), F.lit(1))
    return df.withColumn("_c", change).withColumn("seg", F.sum("_c").over(upto(w))).drop("_c")


def _key(time: Column) -> Column:
    """Times are doubles; milliseconds join exactly."""
    return F.rint(time * 1000).cast("long")


def trip_segments(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """stop_islands, with the rows a second before and after a driving run given to it (the latest run, if several)."""
    rows = stop_islands(df, eps)
    runs = rows.where(~F.col("zero")).groupBy(VID, "seg").agg(F.min(T).alias("t0"), F.max(T).alias("t1"))
    edges = (
        runs.select(VID, "seg", F.explode(F.array(F.col("t0") - 1, F.col("t1") + 1)).alias("t"))
        .groupBy(VID, _key(F.col("t")).alias("_k"))
        .agg(F.max("seg").alias("_seg"))
    )
    return (
        rows.withColumn("_k", _key(F.col(T)))
        .join(edges, [VID, "_k"], "left")
        .withColumn("segment", F.coalesce("_seg", "seg"))
        .drop("_k", "_seg")
    )


def numbered_trips(rows: DataFrame, eps: float = 0.0, vehicles: DataFrame | None = None) -> DataFrame:
    """trip_segments of the rows with trip_id. vehicles: a table that has all their ids and is cheap to read."""
    return number_trips(trip_segments(rows, eps), vehicles=rows if vehicles is None else vehicles)


def number_trips(df: DataFrame, per_range: int = 200_000, vehicles: DataFrame | None = None) -> DataFrame:
    """trip_id: dense number of (vehicle, segment) over all vehicles in order of the id's text, from 1.

    Segments are counted for each vehicle. Vehicles are dealt into ranges of ids of about the same number, by bounds from a
    sample, whatever the ids begin with; only the ranges are numbered in one window.
    """
    trips = df.select(VID, "segment").distinct()
    own = trips.withColumn("_own", F.row_number().over(Window.partitionBy(VID).orderBy("segment")))
    bounds = id_bounds((df if vehicles is None else vehicles).select(VID).distinct(), VID, per_range)
    part = range_of(F.col(VID), bounds)
    counts = trips.groupBy(VID).agg(F.count("*").alias("_count")).withColumn("_range", part)
    offsets = sums_before(counts, VID, "_count", "_range").select(VID, F.col("before").alias("_off"))
    ids = own.join(offsets, VID).select(VID, "segment", (F.col("_off") + F.col("_own")).cast("long").alias("trip_id"))
    return df.join(ids, [VID, "segment"])


def duplicate_boundaries(df: DataFrame) -> DataFrame:
    """A stopped row between two driving rows appears twice; its copy (copy = 1) belongs to the trip before."""
    w = by_time()
    lone = F.col("zero") & ~F.lag("zero", 1, True).over(w) & ~F.lead("zero", 1, True).over(w)
    df = df.withColumn("_lone", lone)
    copies = F.when(F.col("_lone"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.withColumn("copy", F.explode(copies)).drop("_lone")
    back = (F.col("copy") == 1) & (F.col("trip_id") > 1)
    return df.withColumn("trip_id", F.when(back, F.col("trip_id") - 1).otherwise(F.col("trip_id")))


def split_trips(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """Trip ids, doubled boundary rows and kinematics for trajectories with steps of one second."""
    rows = df.where(F.col(V).isNotNull() & F.col(T).isNotNull() & F.col(VID).isNotNull())
    rows = duplicate_boundaries(numbered_trips(rows, eps))
    return trip_kinematics(rows, ties=("copy",))
