"""Leaders and followers: strict as-of joins along the lane graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import hinted
from .kinematics import T, V, VID
from .topology import lane_candidates, most_candidates

SEEN = ("vehicle_id", "flow_pos", "vehicle_speed", "vehicle_lane")


def asof_strict(left: DataFrame, right: DataFrame, by: list[str], at: str, payload: list[str], forward: bool, prefix: str, tie: str) -> DataFrame:
    """left with the payload of the nearest row of right ahead of `at` (or behind), never at the same place.

    Union of both sides and one window: a shuffle and a sort, no pairs. Ties go to the smaller tie value ahead, and to the
    larger behind. Columns by, at and tie are in both sides.
    """
    value = F.struct(F.col(at).alias("_at"), *payload)
    tagged = left.withColumn("_side", F.lit(0)).withColumn("_seen", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType))
    other = right.select(*by, at, tie, F.lit(1).alias("_side"), value.alias("_seen"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    place, last = (F.col(at).desc(), F.col(tie).desc()) if forward else (F.col(at).asc(), F.col(tie).asc())
    w = Window.partitionBy(*by).orderBy(place, F.col("_side").asc(), last).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_seen", ignorenulls=True).over(w)).where("_side = 0")
    columns = [F.col("_found")[c].alias(f"{prefix}{c}") for c in ["_at", *payload]]
    return found.select(*left.columns, *columns)


def neighbours(df: DataFrame, links: DataFrame, lengths: DataFrame, hops: int = 2) -> DataFrame:
    """df with lane_length, vehicle_edge and the vehicle ahead (following_*) and behind (preceding_*) along the lanes."""
    from ..functions.expr import edge_of

    lanes = lane_candidates(links, lengths, hops)
    most = most_candidates(links, lengths, hops)  # of a town few, of a country too many to send everywhere
    own = lengths.select(F.col("lane_id").alias("vehicle_lane"), F.col("length").alias("lane_length"))
    base = df.join(hinted(own, most), "vehicle_lane", "left")
    base = base.withColumn("vehicle_edge", edge_of(F.col("vehicle_lane"))).withColumn("_lane", F.col("vehicle_lane")).withColumn("_pos", F.col("vehicle_pos")).withColumn("_tie", F.col(VID))
    here = df.select(T, F.col("vehicle_lane").alias("_lane")).distinct()
    for ahead, prefix in ((True, "following_"), (False, "preceding_")):
        sign = 1 if ahead else -1
        # of vehicles at one place only that of the ties' rule can be the nearest of any row, so the others go no further
        at_place = (F.min if ahead else F.max)(F.struct(VID, V)).alias("_one")
        moved = (
            df.groupBy(T, "vehicle_lane", "vehicle_pos")
            .agg(at_place)
            .select(T, "vehicle_lane", "vehicle_pos", F.col("_one")[VID].alias(VID), F.col("_one")[V].alias(V))
            .join(hinted(lanes.where(F.col("ahead") == ahead), most), F.col("vehicle_lane") == F.col("candidate"))
            .select(
                T,
                F.col("lane_id").alias("_lane"),
                (F.col("vehicle_pos") + sign * F.col("offset")).alias("_pos"),
                F.col(VID).alias("_tie"),
                VID,
                F.col("vehicle_pos").alias("flow_pos"),
                V,
                "vehicle_lane",
            )
            .join(here, [T, "_lane"], "left_semi")
        )
        base = asof_strict(base, moved, [T, "_lane"], "_pos", list(SEEN), ahead, f"_{prefix}", "_tie")
        base = base.withColumnsRenamed({f"_{prefix}{c}": f"{prefix}{c}" for c in SEEN})
        base = base.withColumn(f"{prefix}headway_distance", sign * (F.col(f"_{prefix}_at") - F.col("_pos"))).drop(f"_{prefix}_at")
    return base.drop("_lane", "_pos", "_tie")


def safe_distance(df: DataFrame, default: float = 2.0) -> DataFrame:
    """(safe_distance): the smallest headway seen."""
    low = F.least(F.min("following_headway_distance"), F.min("preceding_headway_distance"))
    return df.agg(F.coalesce(low, F.lit(default)).alias("safe_distance"))
