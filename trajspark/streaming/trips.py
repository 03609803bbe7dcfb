"""Trips of vehicles as their observations arrive, closed by a stop or by a timer.

A vehicle has a small state while it is on a trip and none otherwise: its last row, the trip's first row and its sums. A
timer closes the trip of a vehicle that isn't heard of for `idle` seconds, and takes its state away; the number of vehicles
that were ever seen doesn't matter, only those on the way. Timers go by event time, which stands still when nothing
arrives, or by the clock; then states also have a time to live. It needs the RocksDB state store (`use_rocksdb`), whose
state is on disk and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.session import ship

OUT = "vehicle_id string, time_start double, time_end double, distance_m double, n_rows long, speed_max double, closed_by string"
STATE = StructType([StructField(c, LongType() if c == "n" else DoubleType()) for c in ("t0", "t", "v", "distance", "n", "v_max")])
#: second 0 of a simulation in event time: watermarks begin at the epoch, and rows at or before it would be late
ORIGIN_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class TripProcessor(StatefulProcessor):
    """Trips of one vehicle: they begin with its first moving row and end with a row of speed 0, or by the timer."""

    def __init__(self, idle: float, by_clock: bool):
        self.idle_ms, self.by_clock = int(idle * 1000), by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trip = handle.getValueState("trip", STATE, 4 * self.idle_ms if self.by_clock else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.trip.get() if self.trip.exists() else None
        found = pd.concat(list(rows)).sort_values(["timestep_time", "vehicle_speed"])
        # rows at or before the last one are late; of rows of one time the slowest counts
        found = found[~found["timestep_time"].duplicated()]
        if held is not None:
            found = found[found["timestep_time"] > held[1]]
        t, v = found["timestep_time"].to_numpy(float), found["vehicle_speed"].to_numpy(float)
        out, held = closed_trips(t, v, held, self.idle_ms / 1000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.trip.clear()
        else:
            self.trip.update(held)
            now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else ORIGIN_MS + int(held[1] * 1000)
            self.handle.registerTimer(now + self.idle_ms)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = [(*_row(self.trip.get()), "idle")] if self.trip.exists() else []
        self.trip.clear()
        yield _frame(key[0], out)

    def close(self) -> None:
        """Nothing is held outside the state."""


def _row(held: tuple) -> tuple:
    t0, t, _, distance, n, v_max = held
    return t0, t, distance, n, v_max


def _frame(vehicle: str, rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame([(vehicle, *r) for r in rows], columns=columns)


def closed_trips(t: np.ndarray, v: np.ndarray, held: tuple | None, idle: float) -> tuple[list[tuple], tuple | None]:
    """Trips that end within these rows of a vehicle, in order of time, and the state of the one that goes on.

    A gap of more than idle ends a trip as the timer would. held: t0, last t, last v, distance, rows, fastest.
    """
    if held is not None:
        t, v = np.append(held[1], t), np.append(held[2], v)
    n = len(t)
    moving, gap = v > 0, np.append(True, np.diff(t) > idle)
    before = np.append(False, moving[:-1])
    begins = moving & (~before | gap)
    trip = np.cumsum(begins)
    # the row that stops a trip belongs to it
    inside = moving | (before & ~gap)
    out: list[tuple] = []
    steps = np.append(0.0, np.where(gap[1:], 0.0, (v[1:] + v[:-1]) / 2 * np.diff(t)))
    for k in range(1, int(trip[-1]) + 1 if n else 0):
        rows = np.flatnonzero((trip == k) & inside)
        first, last = rows[0], rows[-1]
        own = steps[first + 1 : last + 1].sum()
        t0, distance, seen, fastest = t[first], own, len(rows), v[rows].max()
        if held is not None and first == 0:
            t0, distance, seen, fastest = held[0], held[3] + own, held[4] + len(rows) - 1, max(held[5], fastest)
        state = (float(t0), float(t[last]), float(v[last]), float(distance), int(seen), float(fastest))
        if v[last] == 0:
            out.append((*_row(state), "stop"))
        elif last < n - 1:
            out.append((*_row(state), "idle"))
        else:
            return out, state
    return out, None


def online_trips(stream: DataFrame, idle: float = 60.0, late: float = 5.0, by_clock: bool = False) -> DataFrame:
    """(vehicle_id, time_start, time_end, distance_m, n_rows, speed_max, closed_by) of each trip when it is over.

    stream: vehicle_id, timestep_time (seconds), vehicle_speed; rows with a null are dropped, and rows that come behind a
    vehicle's last one. late: seconds by which the whole stream's rows may be late before timers go off. by_clock: timers go
    off `idle` seconds of real time after a vehicle's last row, and its state lives four times as long at most.
    """
    ship(stream.sparkSession)
    rows = stream.select("vehicle_id", "timestep_time", "vehicle_speed").na.drop()
    if not by_clock:
        at = F.timestamp_millis((F.col("timestep_time") * 1000).cast("long") + ORIGIN_MS)
        rows = rows.withColumn("at", at).withWatermark("at", f"{int(late * 1000)} milliseconds")
    mode = "ProcessingTime" if by_clock else "EventTime"
    return rows.groupBy("vehicle_id").transformWithStateInPandas(TripProcessor(idle, by_clock), OUT, "Append", mode)
