"""Kinematics and trips of vehicles as their observations arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import ship

OUT = "vehicle_id string, timestep_time double, vehicle_speed double, vehicle_accel double, odometer double, trip_no long"
STATE = "t double, v double, odo double, trip long, stopped boolean"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_t, last_v, odo, trip, stopped = state.get if state.exists else (None, 0.0, 0.0, 0, True)
    rows = pd.concat(frames).sort_values("timestep_time")
    out = []
    for t, v in zip(rows["timestep_time"], rows["vehicle_speed"], strict=True):
        if last_t is not None and t <= last_t:
            continue  # late: the vehicle's state has gone past it
        dt = t - last_t if last_t is not None else 0.0
        accel = (v - last_v) / dt if dt else 0.0
        odo += 0.5 * (v + last_v) * dt
        if v > 0 and stopped:
            trip += 1
        last_t, last_v, stopped = t, v, v == 0
        out.append((key[0], t, v, accel, odo, trip))
    state.update((last_t, last_v, odo, trip, stopped))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def online_kinematics(stream: DataFrame) -> DataFrame:
    """Backward acceleration, odometer from 0 and number of the trip (from 1, counted up when a vehicle starts to move).

    One small state for each vehicle. Rows at or before a vehicle's last time are late and dropped; within a batch they
    are put in order first. Rows without vehicle, time or speed are dropped.
    """
    ship(stream.sparkSession)
    rows = stream.select("vehicle_id", "timestep_time", "vehicle_speed").na.drop()
    return rows.groupBy("vehicle_id").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time_col: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Observations and vehicles by tumbling window of an event-time column, with a watermark for late rows."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width))
        .agg(F.count("*").alias("n_rows"), F.approx_count_distinct("vehicle_id").alias("n_vehicles"))
        .select("window.start", "window.end", "n_rows", "n_vehicles")
    )
