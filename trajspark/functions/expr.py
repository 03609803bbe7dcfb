"""Column expressions: rounding, bins, names of edges and classes, units, polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Simulation type names by class, looked up in lower case.
VEHICLE_CLASSES = {
    "sedan": ["passenger_3", "passenger_4", "passenger_5", "passenger_6", "passenger_7", "passenger_8",
              "slow_passenger", "fast_passenger", "sedan"],
    "MPV": ["mpv_3", "mpv_4", "mpv_5", "mpv_6", "mpv_7", "mpv_8", "slow_mpv", "fast_mpv", "mpv"],
    "truck": ["truck_3", "truck_4", "truck_5", "truck_6", "truck_7", "truck_8", "slow_truck", "fast_truck", "truck"],
}

# Labels of recorded vehicles by class.
GT_LABELS = {"sedan": ["小轿车"], "MPV": ["MPV商务车"], "truck": ["厢式货车"]}

# Metres per second in one unit.
SPEED_UNITS = {
    "m/s": 1.0, "mps": 1.0, "ms": 1.0, "m_s": 1.0, "km/h": 1 / 3.6, "kmh": 1 / 3.6, "kph": 1 / 3.6, "mph": 0.44704,
}

DEFAULT_CLASS = "sedan"


def number(column: str | Column) -> Column:
    """Double; null for what isn't a finite number."""
    c = F.col(column) if isinstance(column, str) else column
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounded half to even; never -0.0."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def speed_kmh(v: Column) -> Column:
    return clip(F.rint(v * 3.6), 0, 140).cast("int")


def accel_d10(a: Column) -> Column:
    """Acceleration in tenths, the key of emission factors."""
    return clip(F.rint(a * 10), -20, 100).cast("int")


def edge_of(lane: Column) -> Column:
    """Internal lanes (:...) are their own edge; else the last _index goes."""
    return F.when(lane.startswith(":"), lane).otherwise(F.regexp_replace(lane, "_[^_]*$", ""))


def _lookup(key: Column, classes: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for name, keys in classes.items() for k in keys for x in (k, name)]
    return F.element_at(F.create_map(*pairs), key)


def vehicle_class(kind: Column, default: str = DEFAULT_CLASS) -> Column:
    return F.coalesce(_lookup(F.coalesce(F.lower(F.trim(kind)), F.lit("")), VEHICLE_CLASSES), F.lit(default))


def gt_vehicle_class(label: Column, default: str = DEFAULT_CLASS) -> Column:
    name = F.coalesce(F.trim(label), F.lit(""))
    own = _lookup(F.lower(name), {"sedan": ["sedan"], "MPV": ["mpv"], "truck": ["truck"]})
    return F.coalesce(_lookup(name, GT_LABELS), own, F.lit(default))


def to_mps(speed: Column, unit: str) -> Column:
    """An unknown unit is taken as m/s."""
    return speed * F.lit(SPEED_UNITS.get(unit.strip().lower(), 1.0))


def parse_polygon(text: str | None) -> list[tuple[float, float]]:
    """Points of `x1,y1;x2,y2;...`; none if the text is bad or has fewer than three points."""
    try:
        points = [tuple(map(float, p.split(","))) for p in (text or "").split(";") if p.strip()]
    except ValueError:
        return []
    return points if len(points) >= 3 and all(len(p) == 2 for p in points) else []


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule; True for every point if there is no polygon."""
    if not polygon:
        return F.lit(True)
    crossings = []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        at = F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit((y2 - y1) + 1e-30) + F.lit(x1)
        crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1
