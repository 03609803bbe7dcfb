"""The whole analysis as steps over DataFrames, each written as Parquet before the next reads it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import in_polygon, parse_polygon
from ..functions.schema import FCD_ALIASES, GT_TAGS, require, resolve, standard_first
from ..sources.resources import path_exists
from ..operators import emission, envelope, groundtruth, interpolation, kinematics, neighbors, refine, smoothing, spatial, trips

POLLUTANTS = ["NOx", "PM2.5", "CO"]
VARIANT = ["timestep_time", "vehicle_id", "vehicle_speed", "vehicle_accel", "vehicle_odometer", "vehicle_type", "vehicle_x", "vehicle_y"]


@dataclass(frozen=True)
class Settings:
    hops: int = 2
    stop_eps: float = 0.0
    least_pct: float = 90.0
    bin_size: float = 20.0
    roi: str | None = None
    pollutants: tuple[str, ...] = tuple(POLLUTANTS)  # none: all that the factors have
    sim_time: tuple[float | None, float | None] = (None, None)  # first and last second that counts, None is open
    gt_time: tuple[float | None, float | None] = (None, None)
    gt_speed_unit: str = "m/s"
    smooth: bool = True
    refine: bool = True

    def validate(self) -> list[str]:
        problems = [] if self.bin_size > 0 else ["bin_size must be positive"]
        if self.roi and not parse_polygon(self.roi):
            problems.append("roi must be x,y;x,y;x,y;... with three points or more")
        for name, (low, high) in (("sim_time", self.sim_time), ("gt_time", self.gt_time)):
            if low is not None and high is not None and low > high:
                problems.append(f"{name} must not end before it begins")
        return problems


Step = Callable[[dict[str, DataFrame], Settings], DataFrame]


@dataclass
class Pipeline:
    """steps: name -> (function, names it needs). Inputs and results are held by name."""

    spark: SparkSession
    out_dir: str
    settings: Settings = field(default_factory=Settings)
    steps: dict[str, tuple[Step, list[str]]] = field(default_factory=lambda: dict(STEPS))

    def run(
        self, inputs: dict[str, DataFrame], only: list[str] | None = None, resume_from: str | None = None,
        manifest: str | None = None, keep_intermediate: bool = True,
    ) -> dict[str, DataFrame]:
        """Runs the steps in order; those before resume_from are read from out_dir. manifest: local JSON file of timings.

        Without keep_intermediate the folder of a step goes as soon as the last step that reads it is done, and only
        inputs and RESULTS are left. The manifest tells which, and a later resume says which of the folders that it needs
        are gone, and from where it could begin.
        """
        if problems := self.settings.validate():
            raise ValueError("; ".join(problems))
        if resume_from is not None and resume_from not in self.steps:
            raise ValueError(f"no step {resume_from}")
        have, log, reading = dict(inputs), [], resume_from is not None
        chosen = [n for n in self.steps if only is None or n in only]
        if reading:
            self._check_folders(chosen, resume_from, set(inputs))
        for name in chosen:
            step, needs = self.steps[name]
            path = f"{self.out_dir}/{name}"
            reading = reading and name != resume_from
            if reading:
                if self._exists(path):
                    have[name] = self.spark.read.parquet(path)
                continue
            if missing := [n for n in needs if n not in have]:
                log.append({"step": name, "status": "skipped", "missing": missing})
                continue
            began = time.time()
            step(have, self.settings).write.mode("overwrite").parquet(path)
            have[name] = self.spark.read.parquet(path)
            log.append({"step": name, "status": "done", "time_start": began, "time_end": time.time(), "output": path})
            if not keep_intermediate:
                for old in self._finished(chosen, name, have):
                    self._path(f"{self.out_dir}/{old}", delete=True)
                    del have[old]
                    log.append({"step": old, "status": "removed", "after": name})
        if manifest:
            Path(manifest).write_text(json.dumps(log, indent=2))
        return have

    def reads(self, name: str) -> set[str]:
        """What a step reads, where it is there."""
        return {*self.steps[name][1], *OPTIONAL.get(name, [])}

    def _finished(self, chosen: list[str], name: str, have: dict[str, DataFrame]) -> list[str]:
        """Steps up to this one whose folders no later one reads, and that aren't results."""
        later = chosen[chosen.index(name) + 1 :]
        wanted = {x for n in later for x in self.reads(n)}
        return [n for n in chosen[: chosen.index(name) + 1] if n in have and n not in wanted and n not in RESULTS]

    def _check_folders(self, chosen: list[str], resume_from: str, inputs: set[str]) -> None:
        gone = {n for n in self.steps if n not in inputs and not self._exists(f"{self.out_dir}/{n}")}

        def missing(start: str) -> list[str]:
            runs = chosen[chosen.index(start) :] if start in chosen else []
            return sorted({x for n in runs for x in self.steps[n][1] if x in self.steps and x not in runs and x in gone})

        if lacking := missing(resume_from):
            before = [n for n in chosen[: chosen.index(resume_from)] if not missing(n)]
            raise ValueError(
                f"can't resume from {resume_from}: the folders of {', '.join(lacking)} aren't there (removed by a run without "
                f"keep_intermediate, or never written); resume from {before[-1] if before else chosen[0]}"
            )

    def _exists(self, path: str) -> bool:
        return self._path(path)

    def _path(self, path: str, delete: bool = False) -> bool:
        return path_exists(self.spark, path, delete)


def _standard(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    rows = resolve(have["fcd"], FCD_ALIASES, paired=True)
    require(rows, ["timestep_time", "vehicle_id", "vehicle_speed"], "trajectories")
    return kinematics.standardise_fcd(rows.where("timestep_time is not null and vehicle_id is not null"))


def _neighbours(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return neighbors.neighbours(have["standard"], have["links"], have["lanes"], s.hops)


def _trips(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return trips.split_trips(have["neighbours"], s.stop_eps)


def _smooth(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return smoothing.with_odometer(smoothing.smooth_trips(have["trips"].where("copy = 0")))


def _stage_one(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return refine.refine_stage_one(have["trips"].where("copy = 0"))


def _refined(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    """The second stage's rows; refined places are counted from the vehicle's first row, as the simulated odometer is."""
    points = envelope.jerk_points(have["stage_one"], have["jerk_envelope"])
    bad = envelope.bad_cases(points, s.least_pct)
    rows = refine.refine_stage_two(have["stage_one"], bad, have["jerk_envelope"])
    start = F.first("vehicle_odometer", ignorenulls=True).over(kinematics.upto(kinematics.by_time()))
    return rows.withColumn("vehicle_odometer", F.col("vehicle_odometer") - start)


def _variants(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    """All variants together; places of the derived ones come from the simulated ones along the odometer.

    Standard columns come first, then the data type, then what else the tables have, null where a variant lacks it.
    """
    base = have["standard"].select(*VARIANT)
    out = standard_first(have["standard"], VARIANT).withColumn("data_type", F.lit("sumo"))
    none = F.lit(None).cast("double")
    for name, tag in (("refined", "trim"), ("smooth", "sg")):
        if name not in have:
            continue
        rows = have[name]
        if name == "smooth":
            rows = rows.withColumnsRenamed({"speed": "vehicle_speed", "accel": "vehicle_accel", "odometer": "vehicle_odometer"})
            rows = rows.withColumn("vehicle_type", F.lit(None).cast("string"))
        rows = standard_first(rows.withColumns({"vehicle_x": none, "vehicle_y": none}), VARIANT)
        rows = interpolation.fill_xy(interpolation.backfill_type(rows, base), base)
        out = out.unionByName(rows.withColumn("data_type", F.lit(tag)), allowMissingColumns=True)
    if "ground_truth" in have:
        gt = standard_first(groundtruth.standardise(have["ground_truth"], s.gt_speed_unit), VARIANT)
        out = out.unionByName(gt.withColumn("data_type", F.lit("ground_truth")), allowMissingColumns=True)
    return standard_first(out, [*VARIANT, "data_type"])


def _pollutants(have: dict[str, DataFrame], s: Settings) -> list[str]:
    if s.pollutants:
        return list(s.pollutants)
    return sorted(r.pollutant for r in have["factors"].select("pollutant").distinct().collect() if r.pollutant is not None)


def _rates(have: dict[str, DataFrame], s: Settings) -> list[str]:
    """The rate columns of the chosen pollutants; of all that were matched if none is chosen."""
    return [emission.rate_column(p) for p in s.pollutants] or [c for c in have["matched"].columns if c.endswith("_gs")]


def _matched(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return emission.match_factors(have["variants"], emission.wide_factors(have["factors"], _pollutants(have, s)))


def _in_roi(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    polygon = parse_polygon(s.roi)
    rows = have["matched"].where(in_polygon(F.col("vehicle_x"), F.col("vehicle_y"), polygon))
    is_gt = F.lower("data_type").isin(GT_TAGS)
    if s.sim_time == s.gt_time == (None, None):
        return rows
    return spatial.time_between(rows.where(~is_gt), *s.sim_time).unionByName(spatial.time_between(rows.where(is_gt), *s.gt_time))


def _intensity(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    return emission.intensity(_in_roi(have, s), _rates(have, s))


def _spatial(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    polygon, rows = parse_polygon(s.roi), _in_roi(have, s)
    out = None
    for k, axis in enumerate(("vehicle_x", "vehicle_y")):
        origin = min(p[k] for p in polygon) if polygon else rows.agg(F.min(axis)).first()[0] or 0.0
        part = spatial.spatial_by_bin(rows, axis, _rates(have, s), s.bin_size, float(origin))
        out = part if out is None else out.unionByName(part)
    return out


def _errors(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    masses = [c for c in have["spatial"].columns if c.endswith("_g")]
    out = None
    for axis in ("vehicle_x", "vehicle_y"):
        part = spatial.error_pct(have["spatial"].where(F.col("axis") == axis), masses, GT_TAGS).withColumn("axis", F.lit(axis))
        out = part if out is None else out.unionByName(part)
    return out


def _summary(have: dict[str, DataFrame], s: Settings) -> DataFrame:
    parts = [
        spatial.compare_summary(have["errors"].where(F.col("axis") == axis)).withColumn("axis", F.lit(axis))
        for axis in ("vehicle_x", "vehicle_y")
    ]
    return parts[0].unionByName(parts[1])


STEPS: dict[str, tuple[Step, list[str]]] = {
    "standard": (_standard, ["fcd"]),
    "neighbours": (_neighbours, ["standard", "links", "lanes"]),
    "trips": (_trips, ["neighbours"]),
    "smooth": (_smooth, ["trips"]),
    "stage_one": (_stage_one, ["trips"]),
    "refined": (_refined, ["stage_one", "jerk_envelope"]),
    "variants": (_variants, ["standard"]),
    "matched": (_matched, ["variants", "factors"]),
    "intensity": (_intensity, ["matched"]),
    "spatial": (_spatial, ["matched"]),
    "errors": (_errors, ["spatial"]),
    "summary": (_summary, ["errors"]),
}

#: what steps read besides what they need, if it is there
OPTIONAL = {"variants": ["refined", "smooth", "ground_truth"]}
#: steps whose folders are results
RESULTS = {"matched", "intensity", "spatial", "errors", "summary"}

__all__ = ["OPTIONAL", "RESULTS", "STEPS", "Pipeline", "Settings"]
