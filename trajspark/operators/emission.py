"""Emission factors, their match with trajectories, totals and intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import accel_d10, speed_kmh, vehicle_class
from .kinematics import A, V, VID, by_time, step_back

KEYS = ["vehicle_type", "speed_kmh", "accel_d10"]


def rate_column(pollutant: str) -> str:
    return f"{pollutant}_gs"


def wide_factors(factors: DataFrame, pollutants: list[str]) -> DataFrame:
    """A row for each class, speed and acceleration, and a column <pollutant>_gs for each pollutant."""
    wide = factors.groupBy(*KEYS).pivot("pollutant", pollutants).agg(F.min("EmissionFactor_gs"))
    return wide.select(*KEYS, *[F.col(f"`{p}`").alias(rate_column(p)) for p in pollutants])


def keyed(df: DataFrame) -> DataFrame:
    """df with class, and speed and acceleration in the factors' steps; rows without speed or acceleration go."""
    return (
        df.na.drop(subset=[V, A])
        .withColumn("vehicle_type", vehicle_class(F.col("vehicle_type")))
        .withColumn("speed_kmh", speed_kmh(F.col(V)))
        .withColumn("accel_d10", accel_d10(F.col(A)))
    )


def match_factors(df: DataFrame, wide: DataFrame) -> DataFrame:
    """The factor grid has at most 3 x 141 x 121 rows, so it is broadcast."""
    return keyed(df).join(F.broadcast(wide), KEYS, "left")


def match_report(matched: DataFrame, rates: list[str]) -> DataFrame:
    """(pollutant, n_rows, n_missing, pct_missing) for each rate column."""
    rows = matched.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"`{r}`").isNull()).alias(f"m{i}") for i, r in enumerate(rates)]
    )
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("pollutant"), F.col(f"m{i}").alias("m")) for i, r in enumerate(rates)]))
    return rows.select("n", each.alias("r")).select(
        F.col("r.pollutant").alias("pollutant"),
        F.col("n").alias("n_rows"),
        F.col("r.m").alias("n_missing"),
        F.when(F.col("n") > 0, 100.0 * F.col("r.m") / F.col("n")).otherwise(F.lit(0.0)).alias("pct_missing"),
    )


def totals(matched: DataFrame, rates: list[str]) -> DataFrame:
    """(data_type, <p>_g_total): rate times seconds since the vehicle's row before."""
    dt = step_back(by_time("data_type", VID))
    timed = matched.withColumn("_dt", dt)
    sums = [F.coalesce(F.sum(F.col(f"`{r}`") * F.col("_dt")), F.lit(0.0)).alias(f"{r.removesuffix('s')}_total") for r in rates]
    return timed.groupBy("data_type").agg(*sums)


def distances(df: DataFrame, accel: str | None = None) -> DataFrame:
    """(data_type, total_distance_km, n_vehicles): sum of v dt + a dt^2 / 2 by row, never below 0; without accel a = 0."""
    w = by_time("data_type", VID)
    a = F.coalesce(F.col(accel), F.lit(0.0)) if accel else F.lit(0.0)
    dt = step_back(w)
    moved = F.greatest(F.lit(0.0), F.coalesce(F.col(V), F.lit(0.0)) * dt + 0.5 * a * dt * dt)
    rows = df.withColumn("_m", F.when(dt.isNotNull(), moved).otherwise(F.lit(0.0)))
    return rows.groupBy("data_type").agg(
        (F.sum("_m") / 1000).alias("total_distance_km"), F.count_distinct(VID).alias("n_vehicles")
    )


def intensity(matched: DataFrame, rates: list[str], accel: str | None = None) -> DataFrame:
    """totals and distances with <p>_g_per_km, 0 without distance."""
    both = totals(matched, rates).join(distances(matched, accel), "data_type", "left")
    for r in rates:
        g = r.removesuffix("s")
        per = F.when(F.col("total_distance_km") > 0, F.col(f"`{g}_total`") / F.col("total_distance_km")).otherwise(F.lit(0.0))
        both = both.withColumn(f"{g}_per_km", per)
    return both
