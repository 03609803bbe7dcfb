"""Resolving column names of inputs from other tools, and checks on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import number

# Standard names and the names accepted for them, first found wins.
FCD_ALIASES = {
    "timestep_time": ["timestep_time", "time", "t", "sim_time", "step"],
    "vehicle_id": ["vehicle_id", "id", "veh_id", "vehicleID", "vehID"],
    "vehicle_speed": ["vehicle_speed", "speed", "veh_speed", "v", "speed_mps", "vehicle_speed_mps"],
    "vehicle_accel": ["vehicle_accel", "accel", "acceleration", "vehicle_acceleration", "vehicle_acceleration_mps2", "accel_ms2"],
    "vehicle_odometer": ["vehicle_odometer", "odometer", "distance", "mileage", "cumulative_distance", "vehicle_mileage", "mileage_pos"],
    "vehicle_type": ["vehicle_type", "type", "vtype", "vType", "vclass", "vClass"],
    "vehicle_x": ["vehicle_x", "x", "pos_x", "coord_x", "coordinate_x"],
    "vehicle_y": ["vehicle_y", "y", "pos_y", "coord_y", "coordinate_y"],
    "vehicle_lane": ["vehicle_lane", "lane", "lane_id", "laneID", "laneId"],
    "vehicle_pos": ["vehicle_pos", "pos", "lane_pos", "lanePos", "vehicle_position", "position"],
}
GT_ALIASES = {
    "timestep_time": ["timestep_time", "time", "timestamp", "t", "sec", "secs", "second", "seconds"],
    "vehicle_id": ["vehicle_id", "veh_id", "vehid", "id", "veh", "vehicle"],
    "vehicle_type": ["vehicle_type", "veh_type", "vtype", "type", "class", "vclass"],
    "vehicle_speed": ["vehicle_speed", "speed", "v", "vel", "velocity", "veh_speed"],
    "vehicle_accel": ["vehicle_accel", "vehicle_acceleration", "accel", "acceleration", "a", "veh_accel"],
    "vehicle_jerk": ["vehicle_jerk", "jerk", "j"],
    "vehicle_odometer": ["vehicle_odometer", "odometer", "odo", "distance", "dist", "s", "pos", "mileage"],
    "vehicle_x": ["vehicle_x", "x", "pos_x", "position_x", "location_x", "coord_x", "coordinate_x"],
    "vehicle_y": ["vehicle_y", "y", "pos_y", "position_y", "location_y", "coord_y", "coordinate_y"],
}
XY_PAIRS = [
    ("vehicle_x", "vehicle_y"), ("coordinate_x", "coordinate_y"), ("coord_x", "coord_y"), ("pos_x", "pos_y"),
    ("position_x", "position_y"), ("location_x", "location_y"), ("x", "y"),
]
DATA_TYPE_COLUMNS = ["data_type", "source", "type", "method", "category"]
GT_TAGS = ["gt", "ground_truth", "groundtruth"]
RATE_SUFFIXES = ["_gs", "_g", "_grams", "_rate"]
NUMERIC = {"timestep_time", "vehicle_speed", "vehicle_accel", "vehicle_jerk", "vehicle_odometer", "vehicle_x", "vehicle_y", "vehicle_pos"}


def plain(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def resolve(df: DataFrame, aliases: dict[str, list[str]], paired: bool = False, fold: bool = False) -> DataFrame:
    """df's columns under the standard names of aliases (null where df has none), numbers as double.

    fold: names match whatever their case, with _ for blanks. paired: x and y come from one pair of names if any has both.
    """
    have = {(plain(c) if fold else c): c for c in reversed(df.columns)}
    pair = next((p for p in XY_PAIRS if p[0] in have and p[1] in have), None) if paired else None
    out = []
    for name, known in aliases.items():
        if pair and name in ("vehicle_x", "vehicle_y"):
            known = [pair[name == "vehicle_y"]]
        source = next((have[k] for k in known if k in have), None)
        column = F.lit(None).cast("string") if source is None else F.col(f"`{source}`")
        out.append((number(column) if name in NUMERIC else column.cast("string")).alias(name))
    return df.select(*out)


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")


def all_null(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of columns that have no value at all (one aggregate)."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] == 0]


def data_type_column(df: DataFrame) -> str | None:
    have = {c.lower(): c for c in reversed(df.columns)}
    return next((have[c] for c in DATA_TYPE_COLUMNS if c in have), None)


def pollutant_column(columns: list[str], pollutant: str) -> str:
    """The column that holds a pollutant's rate, whatever its case, dots or suffix."""
    base = pollutant.strip().lower()
    forms = {base, base.replace(".", ""), base.replace(".", "_"), re.sub(r"[^a-z0-9]", "", base)}
    have = {c.lower(): c for c in reversed(columns)}
    for form in sorted(forms, key=lambda f: (f != base, f)):
        for suffix in [*RATE_SUFFIXES, ""]:
            if form + suffix in have:
                return have[form + suffix]
    raise ValueError(f"no column for {pollutant!r}; candidates: {[c for c in columns if c.lower().endswith(tuple(RATE_SUFFIXES))]}")


def safe_name(text: str, most: int = 64, default: str = "fcd") -> str:
    return re.sub(r"[^0-9A-Za-z_\-]+", "_", text.strip()).strip("_")[:most] or default


def standard_first(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these columns first, in this order, and its others behind them, in theirs."""
    return df.select(*names, *[F.col(f"`{c}`") for c in df.columns if c not in names])
