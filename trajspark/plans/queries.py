"""A query for each operator over the test tables, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, schema
from ..functions.expr import r6
from ..operators import emission, envelope, groundtruth, interpolation, kinematics, neighbors, refine, smoothing, spatial, topology, trips
from .fixtures import ctes, fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ROI = "29,-45;388,-38;388,-70;29,-73"
POLLUTANTS = ["NOx", "PM2.5", "CO"]
RATES = ["NOx_gs", "PM25_gs", "CO_gs"]
SIZE, ORIGIN = 20.0, 29.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def grams(*names: str, **rounded: str) -> list[Column]:
    """Masses in single precision: their decimal digits often end in ...5, where rounding would hang on the order of sums."""
    return [*[F.col(n) for n in names], *[F.col(v).cast("float").cast("double").alias(k) for k, v in rounded.items()]]


def cols(*names: str, **rounded: str) -> list[Column]:
    return [*[F.col(n) for n in names], *[r6(F.col(v)).alias(k) for k, v in rounded.items()]]


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, "fx_traj")


def kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.backward_accel(traj(spark, sf_dir))


W = "(partition by vehicle_id order by timestep_time)"
UPTO = "(partition by vehicle_id order by timestep_time rows between unbounded preceding and current row)"
BEFORE = "(partition by vehicle_id order by timestep_time rows between unbounded preceding and 1 preceding)"
KIN = f"""kin as (select *, coalesce((vehicle_speed - lag(vehicle_speed) over {W}) / nullif(timestep_time - lag(timestep_time) over {W}, 0e0), 0e0) as vehicle_accel,
    timestep_time - lag(timestep_time) over {W} as dt from fx_traj)"""


def with_traj(sql: str, *more: str) -> str:
    return "with " + ",\n".join([ctes("fx_traj"), KIN, *more]) + "\n" + sql


# ---- names, classes, bins, filters

_CLASS = """case when lower(trim({c})) in ('mpv_3','mpv_4','mpv_5','mpv_6','mpv_7','mpv_8','slow_mpv','fast_mpv','mpv') then 'MPV'
 when lower(trim({c})) in ('truck_3','truck_4','truck_5','truck_6','truck_7','truck_8','slow_truck','fast_truck','truck') then 'truck' else 'sedan' end"""
_CLASS_T = _CLASS.format(c="vehicle_type")
_GT_CLASS = "case when class in ('MPV商务车', 'mpv') then 'MPV' when class = '厢式货车' then 'truck' else 'sedan' end"
_KMH = "cast(greatest(0, least(140, round_even(vehicle_speed * 3.6e0, 0))) as integer)"
_D10 = "cast(greatest(-20, least(100, round_even(vehicle_accel * 10e0, 0))) as integer)"
_MPS = "speed_kmh * (1e0 / 3.6e0)"


@query(f"with {ctes('fx_gt')} select time as timestep_time, id as vehicle_id, class as vehicle_type, speed_kmh as vehicle_speed, coord_x as vehicle_x, coord_y as vehicle_y, cast(null as double) as vehicle_accel from fx_gt")
def alias_project(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_gt").withColumnRenamed("speed_kmh", " Speed").withColumnRenamed("coord_x", "Coord X")
    out = schema.resolve(rows.withColumnRenamed("coord_y", "COORD_Y"), schema.GT_ALIASES, paired=True, fold=True)
    return out.select("timestep_time", "vehicle_id", "vehicle_type", "vehicle_speed", "vehicle_x", "vehicle_y", "vehicle_accel")


@query(with_traj(f"select event_id, {_CLASS_T} as vehicle_class from fx_traj"))
def type_map_default(spark, sf_dir):
    return traj(spark, sf_dir).select("event_id", expr.vehicle_class(F.col("vehicle_type")).alias("vehicle_class"))


@query(with_traj(f"select event_id, {_KMH} as speed_kmh, {_D10} as accel_d10 from kin"))
def discretize_speed_accel(spark, sf_dir):
    return kin(spark, sf_dir).select("event_id", expr.speed_kmh(F.col("vehicle_speed")).alias("speed_kmh"), expr.accel_d10(F.col("vehicle_accel")).alias("accel_d10"))


@query(f"with {ctes('fx_gt')} select o_orderkey, round({_MPS}, 6) as from_kmh, round(speed_kmh * 0.44704e0, 6) as from_mph, speed_kmh as unknown_unit from fx_gt")
def unit_convert(spark, sf_dir):
    v = F.col("speed_kmh")
    return fx(spark, sf_dir, "fx_gt").select("o_orderkey", r6(expr.to_mps(v, "km/h")).alias("from_kmh"), r6(expr.to_mps(v, "mph")).alias("from_mph"), expr.to_mps(v, "knots").alias("unknown_unit"))


@query(with_traj("select event_id, case when starts_with(l, ':') then l else regexp_replace(l, '_[^_]*$', '') end as edge_id from (select event_id, case when event_id % 7 = 0 then ':' || vehicle_lane else vehicle_lane end as l from fx_traj)"))
def lane_to_edge(spark, sf_dir):
    lane = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(":"), F.col("vehicle_lane"))).otherwise(F.col("vehicle_lane"))
    return traj(spark, sf_dir).select("event_id", expr.edge_of(lane).alias("edge_id"))


@query(with_traj("select event_id, timestep_time from fx_traj where timestep_time between 10e0 and 40e0"))
def time_filter(spark, sf_dir):
    return spatial.time_between(traj(spark, sf_dir), 10.0, 40.0).select("event_id", "timestep_time")


def _roi_sql(x: str, y: str) -> str:
    points = expr.parse_polygon(ROI)
    return " + ".join(
        f"(case when (({y1!r}e0 > {y}) <> ({y2!r}e0 > {y})) and {x} < ({x2 - x1!r}e0) * ({y} - ({y1!r}e0)) / ({(y2 - y1) + 1e-30!r}e0) + {x1!r}e0 then 1 else 0 end)"
        for (x1, y1), (x2, y2) in zip(points, points[-1:] + points[:-1], strict=True)
    )


@query(with_traj(f"select event_id, vehicle_x, vehicle_y from fx_traj where ({_roi_sql('vehicle_x', 'vehicle_y')}) % 2 = 1"))
def roi_point_in_polygon(spark, sf_dir):
    inside = expr.in_polygon(F.col("vehicle_x"), F.col("vehicle_y"), expr.parse_polygon(ROI))
    return traj(spark, sf_dir).where(inside).select("event_id", "vehicle_x", "vehicle_y")


@query(with_traj("select event_id from fx_traj where vehicle_id in (select vehicle_id from fx_traj group by 1 having max(abs(vehicle_speed)) > 0)"))
def moving_trip_filter(spark, sf_dir):
    return kinematics.moving_only(traj(spark, sf_dir)).select("event_id")


@query(with_traj("select event_id from fx_traj where (vehicle_id, vehicle_lane) in (select vehicle_id, vehicle_lane from fx_traj where vehicle_speed = 0)"))
def key_semi_join(spark, sf_dir):
    rows = traj(spark, sf_dir)
    keys = rows.where("vehicle_speed = 0").select("vehicle_id", "vehicle_lane")
    return rows.join(keys, ["vehicle_id", "vehicle_lane"], "left_semi").select("event_id")


@query(f"with {ctes('fx_lanes', 'fx_links')} select lane_id from fx_lanes where lane_id not in (select lane_id from fx_links)")
def unused_lane_anti_join(spark, sf_dir):
    return topology.lanes_without_successor(fx(spark, sf_dir, "fx_links"), fx(spark, sf_dir, "fx_lanes")).select("lane_id")


_STACK = f"""gtb as (select id as vehicle_id, time as timestep_time, {_MPS} as vehicle_speed, {_GT_CLASS} as vehicle_type, coord_x as vehicle_x, coord_y as vehicle_y from fx_gt),
gt as (select *, coalesce((vehicle_speed - lag(vehicle_speed) over {W}) / nullif(timestep_time - lag(timestep_time) over {W}, 0e0), 0e0) as vehicle_accel from gtb),
stack as (select 'sumo' as data_type, vehicle_id, timestep_time, vehicle_speed, vehicle_accel, vehicle_type, vehicle_x, vehicle_y from kin
  union all select 'ground_truth', vehicle_id, timestep_time, vehicle_speed, vehicle_accel, vehicle_type, vehicle_x, vehicle_y from gt)"""


def with_stack(sql: str, *more: str) -> str:
    return with_traj(sql, ctes("fx_gt"), _STACK, *more)


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, "fx_gt").withColumnRenamed("speed_kmh", "speed")
    return groundtruth.standardise(rows, "km/h")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated and recorded trajectories together, told by data_type."""
    sim = kin(spark, sf_dir).withColumn("data_type", F.lit("sumo"))
    both = sim.unionByName(gt(spark, sf_dir).withColumn("data_type", F.lit("ground_truth")), allowMissingColumns=True)
    return both.select("data_type", "vehicle_id", "timestep_time", "vehicle_speed", "vehicle_accel", "vehicle_type", "vehicle_x", "vehicle_y")


@query(with_stack("select data_type, vehicle_id, timestep_time, round(vehicle_speed, 6) as speed, round(vehicle_accel, 6) as accel, vehicle_type, vehicle_x from stack"))
def sim_gt_union(spark, sf_dir):
    return stack(spark, sf_dir).select(*cols("data_type", "vehicle_id", "timestep_time", "vehicle_type", "vehicle_x", speed="vehicle_speed", accel="vehicle_accel"))


@query(with_traj("select vehicle_id, vehicle_lane, min(event_id) as event_id from fx_traj group by 1, 2"))
def dedup_keep_first(spark, sf_dir):
    return kinematics.keep_first(traj(spark, sf_dir), ["vehicle_id", "vehicle_lane"], ["event_id"]).select("vehicle_id", "vehicle_lane", "event_id")


@query(with_traj("select vehicle_type, count(*) as n from fx_traj group by 1"))
def value_counts(spark, sf_dir):
    return traj(spark, sf_dir).groupBy("vehicle_type").agg(F.count("*").alias("n"))


@query(f"with {ctes('fx_lanes', 'fx_links')} select distinct regexp_replace(lane_id, '_[^_]*$', '') as from_edge, regexp_replace(next_lane_id, '_[^_]*$', '') as to_edge from fx_links")
def distinct_links(spark, sf_dir):
    return fx(spark, sf_dir, "fx_links").select(expr.edge_of(F.col("lane_id")).alias("from_edge"), expr.edge_of(F.col("next_lane_id")).alias("to_edge")).distinct()


@query(with_traj("select distinct lower(vehicle_type) as vehicle_type from fx_traj where lower(vehicle_type) not in ('sedan', 'mpv', 'mpv_3', 'truck_4')"))
def unknown_types_except(spark, sf_dir):
    known = spark.createDataFrame([(k,) for names in expr.VEHICLE_CLASSES.values() for k in names], "vehicle_type string")
    return traj(spark, sf_dir).select(F.lower("vehicle_type").alias("vehicle_type")).distinct().join(known.select(F.lower("vehicle_type").alias("vehicle_type")), "vehicle_type", "left_anti")


# ---- kinematics


@query(with_traj("select event_id, round(vehicle_accel, 6) as accel from kin"))
def backward_accel(spark, sf_dir):
    return kin(spark, sf_dir).select(*cols("event_id", accel="vehicle_accel"))


_FWD = f"""fa as (select *, coalesce(lead(vehicle_speed) over {W} - vehicle_speed, 0e0) as a from fx_traj),
fj as (select *, coalesce(lead(a) over {W} - a, 0e0) as j, vehicle_speed + 0.5e0 * a as d from fa),
fc as (select *, coalesce(sum(d) over {BEFORE}, 0e0) as cum from fj)"""


@query(with_traj("select event_id, round(a, 6) as accel, round(j, 6) as jerk from fj", _FWD))
def forward_accel_jerk(spark, sf_dir):
    return kinematics.trip_kinematics(traj(spark, sf_dir)).select(*cols("event_id", accel="vehicle_accel", jerk="vehicle_jerk"))


@query(with_traj(f"select event_id, round(sum(vehicle_speed * coalesce(dt, 1e0) + 0.5e0 * vehicle_accel * coalesce(dt, 1e0) * coalesce(dt, 1e0)) over {UPTO}, 6) as odometer from kin"))
def odometer_integral(spark, sf_dir):
    return kinematics.odometer_integral(kin(spark, sf_dir)).select(*cols("event_id", odometer="vehicle_odometer"))


@query(with_traj(f"select event_id, round(cum, 6) as cumulative_distance, round(first_value(vehicle_pos) over {UPTO} + cum, 6) as odometer from fc", _FWD))
def exclusive_cumsum_distance(spark, sf_dir):
    return kinematics.trip_kinematics(traj(spark, sf_dir)).select(*cols("event_id", cumulative_distance="cumulative_distance", odometer="vehicle_odometer"))


_TRAPEZOID = f"""ti as (select *, coalesce(0.5e0 * (vehicle_speed + lag(vehicle_speed) over {W}) * dt, 0e0) as inc from kin),
tr as (select *, sum(inc) over {UPTO} as vehicle_odometer from ti)"""


@query(with_traj("select event_id, round(vehicle_odometer, 6) as odometer from tr", _TRAPEZOID))
def trapezoid_odometer(spark, sf_dir):
    return kinematics.trapezoid_odometer(traj(spark, sf_dir)).select(*cols("event_id", odometer="vehicle_odometer"))


@query(with_traj(f"select event_id, round(s - least(0e0, min(s) over {UPTO}), 6) as speed from si", f"sa as (select *, (vehicle_accel - 1e0) * dt as inc from kin), si as (select *, 2e0 + sum(coalesce(inc, 0e0)) over {UPTO} as s from sa)"))
def clipped_speed_integral(spark, sf_dir):
    rows = kin(spark, sf_dir).withColumn("vehicle_accel", F.col("vehicle_accel") - 1)
    return kinematics.clipped_speed(rows, 2.0).select(*cols("event_id", speed="vehicle_speed"))


@query(with_traj("select count(*) as n, median(dt) as median, (select round(dt, 6) from kin where dt > 0 group by 1 order by count(*) desc, 1 limit 1) as mode, case when abs((select round(dt, 6) from kin where dt > 0 group by 1 order by count(*) desc, 1 limit 1) - median(dt)) <= 1e-6 then (select round(dt, 6) from kin where dt > 0 group by 1 order by count(*) desc, 1 limit 1) else median(dt) end as dt from kin where dt > 0"))
def estimate_dt(spark, sf_dir):
    return kinematics.estimate_dt(traj(spark, sf_dir))


@query(with_traj("select min(dt) filter (dt > 0) as dt_min, median(dt) filter (dt > 0) as dt_median, max(dt) filter (dt > 0) as dt_max, count(*) filter (dt <= 0) as dt_nonpos_count from (select timestep_time - lag(timestep_time) over (partition by vehicle_id order by timestep_time) as dt from fx_traj)"))
def dt_report(spark, sf_dir):
    return kinematics.dt_report(traj(spark, sf_dir))


@query(with_traj("select round(avg(abs(f.a - k.vehicle_accel)), 6) as mae, round(quantile_cont(abs(f.a - k.vehicle_accel), 0.95), 6) as p95 from fa f join kin k using (event_id)", _FWD))
def accel_check_mae_p95(spark, sf_dir):
    rows = kin(spark, sf_dir).withColumnRenamed("vehicle_accel", "derived")
    rows = kinematics.trip_kinematics(rows).withColumnRenamed("vehicle_accel", "given")
    return kinematics.accel_check(rows, "given", "derived").select(*cols(mae="mae", p95="p95"))


# ---- trips

_TRIPS = f"""zs as (select *, vehicle_speed = 0 as zero from fx_traj),
zc as (select *, case when zero = lag(zero) over {W} then 0 else 1 end as chg from zs),
isl as (select *, sum(chg) over {UPTO} as seg from zc),
runs as (select vehicle_id, seg, min(timestep_time) as t0, max(timestep_time) as t1 from isl where not zero group by 1, 2),
edges as (select vehicle_id, t, max(seg) as mseg from (select vehicle_id, seg, t0 - 1 as t from runs union all select vehicle_id, seg, t1 + 1 from runs) group by 1, 2),
segs as (select i.*, coalesce(e.mseg, i.seg) as segment from isl i left join edges e on e.vehicle_id = i.vehicle_id and e.t = i.timestep_time),
ids as (select *, dense_rank() over (order by vehicle_id, segment) as tid from segs),
lone as (select *, zero and not coalesce(lag(zero) over {W}, true) and not coalesce(lead(zero) over {W}, true) as lone from ids),
dup as (select *, 0 as copy, tid as trip_id from lone union all select *, 1, case when tid > 1 then tid - 1 else tid end from lone where lone)"""
_WC = "(partition by vehicle_id order by timestep_time, copy)"
_TK = f"""ta as (select *, coalesce(lead(vehicle_speed) over {_WC} - vehicle_speed, 0e0) as vehicle_accel from dup),
tj as (select *, coalesce(lead(vehicle_accel) over {_WC} - vehicle_accel, 0e0) as vehicle_jerk, vehicle_speed + 0.5e0 * vehicle_accel as distance_m from ta),
tk as (select *, first_value(vehicle_pos) over {_WC} + coalesce(sum(distance_m) over (partition by vehicle_id order by timestep_time, copy rows between unbounded preceding and 1 preceding), 0e0) as vehicle_odometer from tj)"""


@query(with_traj("select event_id, zero, cast(seg as bigint) as seg from isl", _TRIPS))
def stop_islands(spark, sf_dir):
    return trips.stop_islands(traj(spark, sf_dir)).select("event_id", "zero", F.col("seg").cast("long").alias("seg"))


@query(with_traj("select event_id, cast(segment as bigint) as segment from segs", _TRIPS))
def trip_segments(spark, sf_dir):
    return trips.trip_segments(traj(spark, sf_dir)).select("event_id", F.col("segment").cast("long").alias("segment"))


@query(with_traj("select event_id, cast(tid as bigint) as trip_id from ids", _TRIPS))
def global_trip_id(spark, sf_dir):
    return trips.numbered_trips(traj(spark, sf_dir)).select("event_id", "trip_id")


@query(with_traj("select event_id, copy, cast(trip_id as bigint) as trip_id from dup", _TRIPS))
def sandwich_duplicate(spark, sf_dir):
    return trips.duplicate_boundaries(trips.numbered_trips(traj(spark, sf_dir))).select("event_id", "copy", "trip_id")


@query(with_traj("select event_id, copy, cast(trip_id as bigint) as trip_id, round(vehicle_accel, 6) as accel, round(vehicle_jerk, 6) as jerk, round(vehicle_odometer, 6) as odometer from tk", _TRIPS, _TK))
def trip_kinematics(spark, sf_dir):
    return trips.split_trips(traj(spark, sf_dir)).select(*cols("event_id", "copy", "trip_id", accel="vehicle_accel", jerk="vehicle_jerk", odometer="vehicle_odometer"))


# ---- lane graph and neighbours

_CAND = """ahead_c as (select lane_id, lane_id as candidate, 0e0 as off from fx_lanes
  union all select k.lane_id, k.next_lane_id, l.length from fx_links k join fx_lanes l on l.lane_id = k.lane_id
  union all select k.lane_id, k2.next_lane_id, l.length + l2.length from fx_links k join fx_lanes l on l.lane_id = k.lane_id join fx_links k2 on k2.lane_id = k.next_lane_id join fx_lanes l2 on l2.lane_id = k2.lane_id),
behind_c as (select lane_id, lane_id as candidate, 0e0 as off from fx_lanes
  union all select k.next_lane_id, k.lane_id, l.length from fx_links k join fx_lanes l on l.lane_id = k.lane_id
  union all select k.next_lane_id, k2.lane_id, l.length + l2.length from fx_links k join fx_lanes l on l.lane_id = k.lane_id join fx_links k2 on k2.next_lane_id = k.lane_id join fx_lanes l2 on l2.lane_id = k2.lane_id),
cands as (select lane_id, candidate, min(off) as off, true as ahead from ahead_c group by 1, 2 union all select lane_id, candidate, min(off), false from behind_c group by 1, 2)"""
_GRAPH = ctes("fx_lanes", "fx_links")
_LEAD = """leader as (select v.event_id, o.vehicle_id as oid, o.vehicle_pos as opos, o.vehicle_speed as ospeed, o.vehicle_lane as olane, o.vehicle_pos + c.off - v.vehicle_pos as headway
  from fx_traj v join cands c on c.lane_id = v.vehicle_lane and c.ahead join fx_traj o on o.timestep_time = v.timestep_time and o.vehicle_lane = c.candidate
  where o.vehicle_pos + c.off > v.vehicle_pos qualify row_number() over (partition by v.event_id order by o.vehicle_pos + c.off, o.vehicle_id) = 1),
follower as (select v.event_id, o.vehicle_id as oid, o.vehicle_pos as opos, o.vehicle_speed as ospeed, o.vehicle_lane as olane, v.vehicle_pos - (o.vehicle_pos - c.off) as headway
  from fx_traj v join cands c on c.lane_id = v.vehicle_lane and not c.ahead join fx_traj o on o.timestep_time = v.timestep_time and o.vehicle_lane = c.candidate
  where o.vehicle_pos - c.off < v.vehicle_pos qualify row_number() over (partition by v.event_id order by o.vehicle_pos - c.off desc, o.vehicle_id desc) = 1)"""


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbours(traj(spark, sf_dir), fx(spark, sf_dir, "fx_links"), fx(spark, sf_dir, "fx_lanes"))


@query(f"with {_GRAPH}, {_CAND} select lane_id, candidate, off as offset_m, ahead from cands")
def lane_candidates_2hop(spark, sf_dir):
    return topology.lane_candidates(fx(spark, sf_dir, "fx_links"), fx(spark, sf_dir, "fx_lanes")).withColumnRenamed("offset", "offset_m")


_PATHS = """walk(path, lane) as (select [lane_id], lane_id from fx_lanes where lane_id not in (select next_lane_id from fx_links)
  union all select list_append(w.path, k.next_lane_id), k.next_lane_id from walk w join fx_links k on k.lane_id = w.lane where not list_contains(w.path, k.next_lane_id)),
paths as (select distinct array_to_string(path, '>') as path_key, path from walk w where not exists (select 1 from fx_links k where k.lane_id = w.lane)
  or exists (select 1 from fx_links k where k.lane_id = w.lane and list_contains(w.path, k.next_lane_id)))"""


@query(f"with recursive {_GRAPH}, {_PATHS} select path_key from paths")
def lane_paths_recursive(spark, sf_dir):
    return topology.lane_paths(fx(spark, sf_dir, "fx_links")).select(F.array_join("path", ">").alias("path_key"))


@query(f"""with recursive {_GRAPH}, {_PATHS},
steps as (select path_key, unnest(path) as lane_id, generate_subscripts(path, 1) as i from paths),
st as (select s.*, regexp_replace(s.lane_id, '_[^_]*$', '') as edge_id, l.length from steps s left join fx_lanes l using (lane_id)),
ch as (select *, case when edge_id = lag(edge_id) over (partition by path_key order by i) then 0 else 1 end as n from st),
sq as (select *, sum(n) over (partition by path_key order by i rows between unbounded preceding and current row) as seq from ch),
ed as (select path_key, cast(seq as bigint) as seq, edge_id, sum(length) as length from sq group by 1, 2, 3)
select *, sum(length) over (partition by path_key order by seq rows between unbounded preceding and current row) as cumulative from ed""")
def path_compaction(spark, sf_dir):
    return topology.compact_paths(topology.lane_paths(fx(spark, sf_dir, "fx_links")), fx(spark, sf_dir, "fx_lanes"))


_EDGES = """steps as (select path_key, unnest(path) as lane_id, generate_subscripts(path, 1) as i from paths),
st as (select s.*, regexp_replace(s.lane_id, '_[^_]*$', '') as edge_id, l.length from steps s left join fx_lanes l using (lane_id)),
ch as (select *, case when edge_id = lag(edge_id) over (partition by path_key order by i) then 0 else 1 end as n from st),
sq as (select *, sum(n) over (partition by path_key order by i rows between unbounded preceding and current row) as seq from ch),
ed as (select path_key, cast(seq as bigint) as seq, edge_id, sum(length) as length from sq group by 1, 2, 3)"""
_FLOWS = "flows as (select a.lane_id || '>' || a.next_lane_id as flow_id, regexp_replace(a.lane_id, '_[^_]*$', '') as from_edge, regexp_replace(a.next_lane_id, '_[^_]*$', '') as to_edge, cast((l.k * 37) % 10 as double) as vehs_per_hour from fx_links a join fx_lanes l on l.lane_id = a.lane_id)"


@query(f"with {_GRAPH}, {_FLOWS} select from_edge, to_edge, flow_id, vehs_per_hour from flows qualify row_number() over (partition by from_edge, to_edge order by vehs_per_hour desc, flow_id) = 1")
def max_flow_per_od(spark, sf_dir):
    return topology.largest_flow(flows_of(spark, sf_dir))


def flows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, "fx_links").join(fx(spark, sf_dir, "fx_lanes"), "lane_id")
    return rows.select(
        F.concat_ws(">", "lane_id", "next_lane_id").alias("flow_id"), expr.edge_of(F.col("lane_id")).alias("from_edge"),
        expr.edge_of(F.col("next_lane_id")).alias("to_edge"), ((F.col("k") * 37) % 10).cast("double").alias("vehs_per_hour"),
    )


@query(f"""with recursive {_GRAPH}, {_PATHS}, {_EDGES}, {_FLOWS},
pt as (select path_key, string_agg(edge_id, '>' order by seq) as signature, sum(length) as path_len, count(*) as n_edges, arg_min(edge_id, seq) as start_edge, arg_max(edge_id, seq) as end_edge from ed group by 1),
pu as (select * from pt qualify row_number() over (partition by signature order by path_key) = 1),
be as (select regexp_replace(lane_id, '_[^_]*$', '') as a, regexp_replace(next_lane_id, '_[^_]*$', '') as b from fx_links),
od as (select * from flows qualify row_number() over (partition by from_edge, to_edge order by vehs_per_hour desc, flow_id) = 1)
select dense_rank() over (order by signature) - 1 as path_no, signature, path_len, n_edges, start_edge, end_edge, start_edge not in (select b from be where a <> b) as strict_start,
  end_edge not in (select a from be where a <> b) as strict_end, flow_id
from pu left join od on od.from_edge = start_edge and od.to_edge = end_edge""")
def paths_with_flows(spark, sf_dir):
    links = fx(spark, sf_dir, "fx_links")
    compact = topology.compact_paths(topology.lane_paths(links), fx(spark, sf_dir, "fx_lanes"))
    out = topology.path_table(compact, links, flows_of(spark, sf_dir))
    return out.select("path_no", "signature", "path_len", "n_edges", "start_edge", "end_edge", "strict_start", "strict_end", "flow_id")


@query(with_traj("select v.event_id, oid as following_vehicle_id, round(headway, 6) as headway from fx_traj v left join leader using (event_id)", _GRAPH, _CAND, _LEAD))
def asof_leader(spark, sf_dir):
    return near(spark, sf_dir).select(*cols("event_id", "following_vehicle_id", headway="following_headway_distance"))


@query(with_traj("select v.event_id, oid as preceding_vehicle_id, round(headway, 6) as headway from fx_traj v left join follower using (event_id)", _GRAPH, _CAND, _LEAD))
def asof_follower(spark, sf_dir):
    return near(spark, sf_dir).select(*cols("event_id", "preceding_vehicle_id", headway="preceding_headway_distance"))


@query(with_traj("""select v.event_id, n.length as lane_length, regexp_replace(v.vehicle_lane, '_[^_]*$', '') as vehicle_edge, l.oid as following_vehicle_id, l.opos as following_flow_pos, l.ospeed as following_vehicle_speed, l.olane as following_vehicle_lane,
 f.oid as preceding_vehicle_id, f.opos as preceding_flow_pos, f.ospeed as preceding_vehicle_speed, f.olane as preceding_vehicle_lane
 from fx_traj v left join fx_lanes n on n.lane_id = v.vehicle_lane left join leader l using (event_id) left join follower f using (event_id)""", _GRAPH, _CAND, _LEAD))
def neighbors_full(spark, sf_dir):
    side = [f"{p}_{c}" for p in ("following", "preceding") for c in neighbors.SEEN]
    return near(spark, sf_dir).select("event_id", "lane_length", "vehicle_edge", *side)


@query(with_traj("select event_id, length as lane_length from fx_traj left join fx_lanes on lane_id = vehicle_lane", _GRAPH))
def lane_length_join(spark, sf_dir):
    lanes = fx(spark, sf_dir, "fx_lanes").select(F.col("lane_id").alias("vehicle_lane"), F.col("length").alias("lane_length"))
    return traj(spark, sf_dir).join(lanes, "vehicle_lane", "left").select("event_id", "lane_length")


@query(f"with {_GRAPH} select k.lane_id, k.next_lane_id, a.length as lane_length, b.length as next_lane_length from fx_links k left join fx_lanes a on a.lane_id = k.lane_id left join fx_lanes b on b.lane_id = k.next_lane_id")
def link_lengths(spark, sf_dir):
    return topology.link_lengths(fx(spark, sf_dir, "fx_links"), fx(spark, sf_dir, "fx_lanes")).select("lane_id", "next_lane_id", "lane_length", "next_lane_length")


@query(f"with {_GRAPH} select n.lane_id, k.next_lane_id, n.length as lane_length, b.length as next_lane_length from fx_lanes n left join fx_links k on k.lane_id = n.lane_id left join fx_lanes b on b.lane_id = k.next_lane_id")
def lane_table_ordered(spark, sf_dir):
    return topology.lane_table(fx(spark, sf_dir, "fx_links"), fx(spark, sf_dir, "fx_lanes"))


_CONNECTIONS = """cn as (select regexp_replace(lane_id, '_[^_]*$', '') as f, regexp_replace(next_lane_id, '_[^_]*$', '') as t, regexp_replace(lane_id, '^.*_', '') as fl,
  regexp_replace(next_lane_id, '^.*_', '') as tl, case when lane_id < next_lane_id then ':' || lane_id || next_lane_id end as via from fx_links)"""


@query(f"""with {_GRAPH}, {_CONNECTIONS}
select f || '_' || fl as lane_id, t || '_' || tl as next_lane_id from cn where via is null union select f || '_' || fl, via from cn where via is not null
union select via, t || '_' || tl from cn where via is not null""")
def via_links(spark, sf_dir):
    """Links out of connections, of which some lead over an internal lane."""
    rows, lane, to = fx(spark, sf_dir, "fx_links"), F.col("lane_id"), F.col("next_lane_id")
    number = lambda x: F.substring_index(x, "_", -1)
    via = F.when(lane < to, F.concat(F.lit(":"), lane, to))
    connections = rows.select(
        expr.edge_of(lane).alias("from"), expr.edge_of(to).alias("to"), number(lane).alias("fromLane"), number(to).alias("toLane"), via.alias("via")
    )
    return topology.lane_links(connections)


@query(f"with {_GRAPH} select lane_id, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from (select next_lane_id as lane_id, 1 as i, 0 as o from fx_links union all select lane_id, 0, 1 from fx_links) group by 1")
def lane_degrees(spark, sf_dir):
    return topology.degrees(fx(spark, sf_dir, "fx_links"))


@query(with_traj("select round(coalesce(least((select min(headway) from leader), (select min(headway) from follower)), 2e0), 6) as safe_distance", _GRAPH, _CAND, _LEAD))
def safe_distance(spark, sf_dir):
    return neighbors.safe_distance(near(spark, sf_dir)).select(*cols(safe_distance="safe_distance"))


# ---- variants

_KNOTS = f"""tq as (select * replace (round(vehicle_odometer, 6) as vehicle_odometer) from tr),
kn0 as (select vehicle_id, vehicle_odometer as o, vehicle_x as x, vehicle_y as y, lag(vehicle_odometer) over (partition by vehicle_id order by vehicle_odometer, timestep_time) as p from tq),
kn as (select vehicle_id, o, x, y from kn0 where p is null or p <> o),
qs as (select event_id, vehicle_id, vehicle_odometer * 1.01e0 - 0.3e0 as o from tq),
up as (select q.event_id, k.o as ao, k.x as ax, k.y as ay from qs q asof join kn k on q.vehicle_id = k.vehicle_id and q.o >= k.o),
dn as (select q.event_id, k.o as bo, k.x as bx, k.y as by_ from qs q asof join kn k on q.vehicle_id = k.vehicle_id and q.o <= k.o),
ip as (select q.event_id, q.o, coalesce(ao, bo) as ao, coalesce(ax, bx) as ax, coalesce(ay, by_) as ay, coalesce(bo, ao) as bo, coalesce(bx, ax) as bx, coalesce(by_, ay) as by_ from qs q left join up using (event_id) left join dn using (event_id))"""


@query(with_traj("select event_id, round(ax + (bx - ax) * case when bo > ao then (o - ao) / (bo - ao) else 0e0 end, 6) as x, round(ay + (by_ - ay) * case when bo > ao then (o - ao) / (bo - ao) else 0e0 end, 6) as y from ip", _TRAPEZOID, _KNOTS))
def interp_xy_fill(spark, sf_dir):
    base = kinematics.trapezoid_odometer(traj(spark, sf_dir))
    base = base.withColumn("vehicle_odometer", r6(F.col("vehicle_odometer")))
    none = F.lit(None).cast("double")
    variant = base.withColumn("vehicle_odometer", F.col("vehicle_odometer") * 1.01 - 0.3).withColumns({"vehicle_x": none, "vehicle_y": none})
    return interpolation.fill_xy(variant, base).select(*cols("event_id", x="vehicle_x", y="vehicle_y"))


@query(with_traj("select event_id, coalesce(case when event_id % 4 = 0 then vehicle_type end, f.t, 'sedan') as vehicle_type from fx_traj left join (select vehicle_id, arg_min(vehicle_type, timestep_time) as t from fx_traj where timestep_time >= 1 group by 1) f using (vehicle_id)"))
def vehicle_type_backfill(spark, sf_dir):
    base = traj(spark, sf_dir)
    variant = base.withColumn("vehicle_type", F.when(F.col("event_id") % 4 == 0, F.col("vehicle_type")))
    return interpolation.backfill_type(variant, base.where("timestep_time >= 1")).select("event_id", "vehicle_type")


# ---- emissions


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = emission.wide_factors(fx(spark, sf_dir, "fx_ef"), POLLUTANTS)
    return factors.withColumnRenamed("PM2.5_gs", "PM25_gs")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emission.match_factors(stack(spark, sf_dir), wide(spark, sf_dir))


_EF = ctes("fx_ef") + """,
wide as (select vehicle_type, speed_kmh, accel_d10, min(case when pollutant = 'NOx' then EmissionFactor_gs end) as NOx_gs,
  min(case when pollutant = 'PM2.5' then EmissionFactor_gs end) as PM25_gs, min(case when pollutant = 'CO' then EmissionFactor_gs end) as CO_gs from fx_ef group by 1, 2, 3)"""
_MATCH = f"""keyed as (select * replace ({_CLASS_T} as vehicle_type), {_KMH} as speed_kmh, {_D10} as accel_d10 from stack),
matched as (select * from keyed left join wide using (vehicle_type, speed_kmh, accel_d10))"""
_WD = "(partition by data_type, vehicle_id order by timestep_time)"
_TOTAL = f"""timed as (select *, timestep_time - lag(timestep_time) over {_WD} as dt from matched),
totals as (select data_type, coalesce(sum(NOx_gs * dt), 0e0) as n, coalesce(sum(PM25_gs * dt), 0e0) as p, coalesce(sum(CO_gs * dt), 0e0) as c,
  sum(case when dt > 0 then greatest(0e0, vehicle_speed * dt) else 0e0 end) / 1000e0 as km, count(distinct vehicle_id) as n_vehicles from timed group by 1)"""


@query(f"with {_EF} select vehicle_type, speed_kmh, accel_d10, round(NOx_gs, 9) as NOx_gs, round(PM25_gs, 9) as PM25_gs, round(CO_gs, 9) as CO_gs from wide")
def ef_pivot(spark, sf_dir):
    return wide(spark, sf_dir).select(*emission.KEYS, *[F.round(r, 9).alias(r) for r in RATES])


@query(with_stack("select data_type, vehicle_id, timestep_time, vehicle_type, speed_kmh, accel_d10, round(NOx_gs, 9) as NOx_gs, round(PM25_gs, 9) as PM25_gs, round(CO_gs, 9) as CO_gs from matched", _EF, _MATCH))
def ef_match(spark, sf_dir):
    return matched(spark, sf_dir).select("data_type", "vehicle_id", "timestep_time", *emission.KEYS, *[F.round(r, 9).alias(r) for r in RATES])


_REPORT = " union all ".join(f"select '{r}' as pollutant, count(*) as n_rows, count(*) filter (where {r} is null) as n_missing, round(100e0 * count(*) filter (where {r} is null) / count(*), 6) as pct_missing from matched" for r in RATES)


@query(with_stack(_REPORT, _EF, _MATCH))
def ef_match_report(spark, sf_dir):
    return emission.match_report(matched(spark, sf_dir), RATES).select(*cols("pollutant", "n_rows", "n_missing", pct_missing="pct_missing"))


@query(with_stack("select data_type, cast(cast(n as real) as double) as NOx_g_total, cast(cast(p as real) as double) as PM25_g_total, cast(cast(c as real) as double) as CO_g_total from totals", _EF, _MATCH, _TOTAL))
def emission_totals(spark, sf_dir):
    return emission.totals(matched(spark, sf_dir), RATES).select(*grams("data_type", NOx_g_total="NOx_g_total", PM25_g_total="PM25_g_total", CO_g_total="CO_g_total"))


@query(with_stack("select data_type, round(km, 6) as total_distance_km, n_vehicles from totals", _EF, _MATCH, _TOTAL))
def vehicle_distance(spark, sf_dir):
    return emission.distances(stack(spark, sf_dir)).select(*cols("data_type", "n_vehicles", total_distance_km="total_distance_km"))


@query(with_stack("select data_type, cast(cast(n as real) as double) as NOx_g_total, cast(cast(km as real) as double) as total_distance_km, n_vehicles, cast(cast(case when km > 0 then n / km else 0e0 end as real) as double) as NOx_g_per_km, cast(cast(case when km > 0 then p / km else 0e0 end as real) as double) as PM25_g_per_km, cast(cast(case when km > 0 then c / km else 0e0 end as real) as double) as CO_g_per_km from totals", _EF, _MATCH, _TOTAL))
def emission_intensity(spark, sf_dir):
    out = emission.intensity(matched(spark, sf_dir), RATES)
    return out.select(*grams("data_type", "n_vehicles", NOx_g_total="NOx_g_total", total_distance_km="total_distance_km", NOx_g_per_km="NOx_g_per_km", PM25_g_per_km="PM25_g_per_km", CO_g_per_km="CO_g_per_km"))


def _spatial_sql(axis: str) -> str:
    return f"""fwd as (select *, lead({axis}) over {_WD} as e, lead(timestep_time) over {_WD} - timestep_time as dur from matched),
cells as (select data_type, unnest(range(cast(floor(least({axis}, e)) as bigint), cast(floor(greatest({axis}, e)) as bigint) + 1)) as m,
  floor(greatest({axis}, e)) - floor(least({axis}, e)) + 1 as n, NOx_gs * dur as a, PM25_gs * dur as b, CO_gs * dur as c from fwd where dur > 0 and e is not null and {axis} is not null),
bins as (select data_type, cast(floor((m - {ORIGIN}e0) / {SIZE}e0) as bigint) as axis_bin, coalesce(sum(a / n), 0e0) as a, coalesce(sum(b / n), 0e0) as b, coalesce(sum(c / n), 0e0) as c from cells group by 1, 2)"""


def _spatial_rows(axis: str) -> str:
    return f"select '{axis}' as axis, axis_bin, data_type, cast(cast(a as real) as double) as NOx_g, cast(cast(b as real) as double) as PM25_g, cast(cast(c as real) as double) as CO_g, {ORIGIN}e0 + axis_bin * {SIZE}e0 as bin_start_m, {ORIGIN}e0 + axis_bin * {SIZE}e0 + {SIZE / 2}e0 as bin_center_m, {ORIGIN}e0 + axis_bin * {SIZE}e0 + {SIZE}e0 as bin_end_m from bins"


def _spatial(df: DataFrame) -> DataFrame:
    return df.select(*grams("axis", "axis_bin", "data_type", "bin_start_m", "bin_center_m", "bin_end_m", NOx_g="NOx_g", PM25_g="PM25_g", CO_g="CO_g"))


@query(with_stack(_spatial_rows("vehicle_x"), _EF, _MATCH, _spatial_sql("vehicle_x")))
def spatial_emission_x(spark, sf_dir):
    return _spatial(spatial.spatial_by_bin(matched(spark, sf_dir), "vehicle_x", RATES, SIZE, ORIGIN))


@query(with_stack(_spatial_rows("vehicle_y"), _EF, _MATCH, _spatial_sql("vehicle_y")))
def spatial_emission_y(spark, sf_dir):
    return _spatial(spatial.spatial_by_bin(matched(spark, sf_dir), "vehicle_y", RATES, SIZE, ORIGIN))


@query(with_stack(_spatial_rows("vehicle_x"), _EF, _MATCH, _spatial_sql("vehicle_x")))
def spatial_emission_by_metre(spark, sf_dir):
    return _spatial(spatial.spatial_by_metre(matched(spark, sf_dir), "vehicle_x", RATES, SIZE, ORIGIN))


_ERROR = """lng as (select axis_bin, data_type, 'NOx' as pollutant, a as value from bins union all select axis_bin, data_type, 'PM25', b from bins union all select axis_bin, data_type, 'CO', c from bins),
errs as (select s.axis_bin, s.data_type, g.data_type as gt_type, s.pollutant, s.value, g.value as gt_value, case when abs(g.value) > 1e-9 then (s.value - g.value) / g.value * 100e0 end as error_pct
  from lng s join lng g on g.axis_bin = s.axis_bin and g.pollutant = s.pollutant and g.data_type = 'ground_truth' and s.data_type <> 'ground_truth')"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = spatial.spatial_by_bin(matched(spark, sf_dir), "vehicle_x", RATES, SIZE, ORIGIN)
    return spatial.error_pct(sums, ["NOx_g", "PM25_g", "CO_g"], schema.GT_TAGS)


@query(with_stack("select axis_bin, data_type, gt_type, pollutant, cast(cast(value as real) as double) as value, cast(cast(gt_value as real) as double) as gt_value, round(error_pct, 4) as error_pct from errs", _EF, _MATCH, _spatial_sql("vehicle_x"), _ERROR))
def gt_error_pct(spark, sf_dir):
    return errors(spark, sf_dir).select(*grams("axis_bin", "data_type", "gt_type", "pollutant", value="value", gt_value="gt_value"), F.round("error_pct", 4).alias("error_pct"))


@query(with_stack("select pollutant, axis_bin, round(max(case when data_type = 'sumo' then error_pct end), 4) as sumo from errs group by 1, 2", _EF, _MATCH, _spatial_sql("vehicle_x"), _ERROR))
def compare_pivot(spark, sf_dir):
    return spatial.compare_pivot(errors(spark, sf_dir), ["sumo"]).select("pollutant", "axis_bin", F.round("sumo", 4).alias("sumo"))


@query(with_stack("select pollutant, data_type, gt_type, count(error_pct) as n_bins, cast(cast(sum(value) as real) as double) as total, cast(cast(sum(gt_value) as real) as double) as gt_total, round(avg(abs(error_pct)), 3) as mean_abs_error_pct, round(max(abs(error_pct)), 3) as max_abs_error_pct from errs group by 1, 2, 3", _EF, _MATCH, _spatial_sql("vehicle_x"), _ERROR))
def compare_summary(spark, sf_dir):
    out = spatial.compare_summary(errors(spark, sf_dir))
    return out.select(
        *grams("pollutant", "data_type", "gt_type", "n_bins", total="total", gt_total="gt_total"),
        F.round("mean_abs_error_pct", 3).alias("mean_abs_error_pct"), F.round("max_abs_error_pct", 3).alias("max_abs_error_pct"),
    )


@query(with_stack("select axis_bin, data_type, cast(cast(a as real) as double) as NOx_g from bins order by a desc, axis_bin, data_type limit 10", _EF, _MATCH, _spatial_sql("vehicle_x")))
def top_emitters_topk(spark, sf_dir):
    sums = spatial.spatial_by_bin(matched(spark, sf_dir), "vehicle_x", RATES, SIZE, ORIGIN)
    return spatial.top_cells(sums, "NOx_g", 10).select(*grams("axis_bin", "data_type", NOx_g="NOx_g"))


# ---- envelopes and refinement

_ENV = ctes("fx_jerk_env")
_WT = "(partition by vehicle_id, trip_id order by timestep_time)"
_POINTS = f"""one as (select *, vehicle_speed * 0.2e0 as v2 from ids),
tra as (select o.vehicle_id, o.tid as trip_id, o.timestep_time, o.event_id, coalesce((o.v2 - lag(o.v2) over (partition by vehicle_id order by timestep_time)), 0e0) as a from one o),
pts as (select *, (lead(a) over {_WT} - a) / coalesce(nullif(timestep_time - lag(timestep_time) over {_WT}, 0e0), 1e0) as jerk from tra),
ptj as (select p.*, e.jerk_min, e.jerk_max, coalesce(p.jerk >= e.jerk_min and p.jerk <= e.jerk_max, false) as inside,
  row_number() over {_WT} as i, count(*) over (partition by vehicle_id, trip_id) as n from pts p left join fx_jerk_env e on e.accel_d10 = cast(round_even(p.a * 10e0, 0) as integer)),
cases as (select vehicle_id, trip_id, count(*) as n_points, count(*) filter (where inside) as n_inside, 100e0 * count(*) filter (where inside) / count(*) as pct from ptj where jerk is not null group by 1, 2)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips.numbered_trips(traj(spark, sf_dir))
    rows = kinematics.backward_accel(rows.withColumn("vehicle_speed", F.col("vehicle_speed") * 0.2))
    return envelope.jerk_points(rows, fx(spark, sf_dir, "fx_jerk_env"))


@query(with_traj("select event_id, round(jerk, 6) as jerk, inside from ptj", _TRIPS, _ENV, _POINTS))
def envelope_in_range(spark, sf_dir):
    return points(spark, sf_dir).select(*cols("event_id", "inside", jerk="jerk"))


@query(with_traj("select vehicle_id, cast(trip_id as bigint) as trip_id, n_points, n_inside, round(pct, 6) as pct from cases where n_points >= 3 and pct < 90", _TRIPS, _ENV, _POINTS))
def envelope_bad_cases(spark, sf_dir):
    return envelope.bad_cases(points(spark, sf_dir)).select(*cols("vehicle_id", "trip_id", "n_points", "n_inside", pct="pct"))


@query(with_traj("select vehicle_id, cast(trip_id as bigint) as trip_id from ptj where n >= 3 and i > 1 and i < n group by 1, 2 having not bool_and(inside)", _TRIPS, _ENV, _POINTS))
def envelope_strict_all(spark, sf_dir):
    return envelope.strict_bad_cases(points(spark, sf_dir)).select("vehicle_id", "trip_id")


def _stages(spark: SparkSession, sf_dir: str, together: bool) -> DataFrame:
    base = kin(spark, sf_dir)
    new = base.where("event_id % 3 = 0").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("vehicle_speed") + 1).alias("vehicle_speed"),
        (F.col("vehicle_accel") * 2).alias("vehicle_accel"),
        F.when(F.col("event_id") % 2 == 0, F.col("vehicle_pos") + 3).alias("vehicle_pos"),
    )
    out = envelope.overwrite(base, new, ["event_id"], ["vehicle_speed", "vehicle_accel", "vehicle_pos"], together)
    return out.select(*cols("event_id", speed="vehicle_speed", accel="vehicle_accel", pos="vehicle_pos"))


@query(with_traj("select event_id, round(case when event_id % 15 <> 0 and event_id % 3 = 0 then vehicle_speed + 1e0 else vehicle_speed end, 6) as speed, round(case when event_id % 3 = 0 then vehicle_accel * 2e0 else vehicle_accel end, 6) as accel, round(case when event_id % 6 = 0 then vehicle_pos + 3e0 else vehicle_pos end, 6) as pos from kin"))
def stage_overwrite_any(spark, sf_dir):
    return _stages(spark, sf_dir, together=False)


@query(with_traj("select event_id, round(case when event_id % 6 = 0 and event_id % 5 <> 0 then vehicle_speed + 1e0 else vehicle_speed end, 6) as speed, round(case when event_id % 6 = 0 and event_id % 5 <> 0 then vehicle_accel * 2e0 else vehicle_accel end, 6) as accel, round(case when event_id % 6 = 0 and event_id % 5 <> 0 then vehicle_pos + 3e0 else vehicle_pos end, 6) as pos from kin"))
def stage_overwrite_all3(spark, sf_dir):
    return _stages(spark, sf_dir, together=True)


# ---- smoothing


#: weights of a quadratic fit to m points x = -h..h, at point x0, for point x: with the sums s0 = m, s2 and s4 of x^0, x^2
#: and x^4, they are (s4 - s2 (x0^2 + x^2) + s0 x0^2 x^2) / (s0 s4 - s2^2) + x0 x / s2
_WEIGHTS = """ws(w) as (values (5), (7), (9), (11)),
wx as (select w, unnest(range(-(w // 2), w // 2 + 1)) as x from ws),
wm as (select w, count(*) as s0, sum(x * x)::double as s2, sum(x * x * x * x)::double as s4 from wx group by w),
sc as (select a.w, a.x + a.w // 2 as i, b.x + b.w // 2 as j,
  (s4 - s2 * (a.x * a.x + b.x * b.x) + s0 * a.x * a.x * b.x * b.x) / (s0 * s4 - s2 * s2) + a.x * b.x / s2 as c
  from wx a join wx b on a.w = b.w join wm on wm.w = a.w)"""


_SG = f"""{_WEIGHTS},
sb as (select *, row_number() over {_WT} - 1 as i, count(*) over (partition by vehicle_id, trip_id) as n from (select vehicle_id, tid as trip_id, timestep_time, event_id, vehicle_speed as v from ids)),
so as (select *, sum(v) over (partition by vehicle_id order by timestep_time rows between unbounded preceding and current row) as odo, case when n >= 11 then 11 when n >= 9 then 9 when n >= 7 then 7 when n >= 5 then 5 else 0 end as w from sb),
sw as (select *, case when i < w // 2 then i when i >= n - w // 2 then i - n + w else w // 2 end as at from so),
sf as (select a.vehicle_id, a.trip_id, a.i, sum(s.c * b.v) as s from sw a join sc s on s.w = a.w and s.i = a.at join sw b on b.vehicle_id = a.vehicle_id and b.trip_id = a.trip_id and b.i = a.i - a.at + s.j group by 1, 2, 3),
s1 as (select a.*, case when (a.i = 0 or a.i = a.n - 1) and abs(a.v) <= 1e-6 then 0e0 else greatest(0e0, least(60e0, coalesce(f.s, a.v))) end as s from sw a left join sf f on f.vehicle_id = a.vehicle_id and f.trip_id = a.trip_id and f.i = a.i),
s2 as (select *, coalesce(lead(timestep_time) over {_WT} - timestep_time, 0e0) as dt, greatest(-10e0, least(10e0, coalesce((lead(s) over {_WT} - s) / nullif(lead(timestep_time) over {_WT} - timestep_time, 0e0), 0e0))) as a from s1),
s3 as (select *, greatest(0e0, least(60e0, first_value(s) over {_WT} + coalesce(sum(a * dt) over (partition by vehicle_id, trip_id order by timestep_time rows between unbounded preceding and 1 preceding), 0e0))) as r from s2),
s4 as (select *, coalesce(0.5e0 * (r + lag(r) over {_WT}) * lag(dt) over {_WT}, 0e0) as d from s3),
s5 as (select *, sum(d) over (partition by vehicle_id, trip_id) as dist, max(odo) over (partition by vehicle_id, trip_id) - min(odo) over (partition by vehicle_id, trip_id) as span from s4),
s6 as (select *, greatest(0e0, least(60e0, case when span > 0 and dist > 1e-9 and n > 2 and i > 0 and i < n - 1 then r * span / dist else r end)) as z from s5),
s7 as (select *, greatest(-10e0, least(10e0, coalesce((lead(z) over {_WT} - z) / nullif(lead(timestep_time) over {_WT} - timestep_time, 0e0), 0e0))) as a2 from s6),
s8 as (select *, greatest(0e0, least(60e0, first_value(z) over {_WT} + coalesce(sum(a2 * dt) over (partition by vehicle_id, trip_id order by timestep_time rows between unbounded preceding and 1 preceding), 0e0))) as r2 from s7),
sm as (select vehicle_id, trip_id, timestep_time, case when span > 0 then r2 else r end as speed, case when span > 0 then a2 else a end as accel from s8)"""


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips.numbered_trips(traj(spark, sf_dir))
    w = kinematics.upto(kinematics.by_time())
    return smoothing.smooth_trips(rows.withColumn("vehicle_odometer", F.sum("vehicle_speed").over(w)))


@query(with_traj("select vehicle_id, cast(trip_id as bigint) as trip_id, timestep_time, round(speed, 4) + 0e0 as speed, round(accel, 4) + 0e0 as accel from sm", _TRIPS, _SG))
def sg_smooth(spark, sf_dir):
    return smoothed(spark, sf_dir).select("vehicle_id", "trip_id", "timestep_time", *[(F.round(c, 4) + 0.0).alias(c) for c in ("speed", "accel")])


@query(with_traj(f"""select vehicle_id, timestep_time, round(coalesce(lead(accel) over {W} - accel, 0e0), 4) + 0e0 as jerk, round(sum(inc) over {UPTO}, 4) as odometer
from (select *, coalesce(0.5e0 * (speed + lag(speed) over {W}) * (timestep_time - lag(timestep_time) over {W}), 0e0) as inc from sm)""", _TRIPS, _SG))
def sg_odometer(spark, sf_dir):
    out = smoothing.with_odometer(smoothed(spark, sf_dir))
    return out.select("vehicle_id", "timestep_time", (F.round("jerk", 4) + 0.0).alias("jerk"), F.round("odometer", 4).alias("odometer"))


@query(f"""with {ctes('fx_gt')}, g as (select id as vehicle_id, time as timestep_time, {_MPS} as v, {_GT_CLASS} as vehicle_type, coord_x as vehicle_x from fx_gt)
select vehicle_id, timestep_time, vehicle_type, vehicle_x, round(v, 6) as speed, round(coalesce((v - lag(v) over {W}) / (timestep_time - lag(timestep_time) over {W}), 0e0), 6) as accel,
 round(sum(case when timestep_time > 0 then v else 0e0 end) over {UPTO}, 6) as odometer from g""")
def gt_standardize(spark, sf_dir):
    return gt(spark, sf_dir).select(*cols("vehicle_id", "timestep_time", "vehicle_type", "vehicle_x", speed="vehicle_speed", accel="vehicle_accel", odometer="vehicle_odometer"))


@query(with_traj(f"""select vehicle_id, timestep_time, round(coalesce((lead(vehicle_speed) over {W} - vehicle_speed) / 1e0, 0e0), 6) as accel,
 round(sum(coalesce(0.5e0 * (vehicle_speed + lag_v) * (timestep_time - lag_t), 0e0)) over {UPTO}, 6) as odometer
from (select *, lag(vehicle_speed) over {W} as lag_v, lag(timestep_time) over {W} as lag_t from fx_traj)"""))
def missing_kinematics(spark, sf_dir):
    out = kinematics.fill_missing_kinematics(traj(spark, sf_dir), 1.0, accel=True, odometer=True)
    return out.select(*cols("vehicle_id", "timestep_time", accel="vehicle_accel", odometer="vehicle_odometer"))


def slow_trips(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = (traj(spark, sf_dir) if rows is None else rows).withColumn("vehicle_speed", F.col("vehicle_speed") * 0.2)
    return kinematics.backward_accel(trips.numbered_trips(rows, vehicles=traj(spark, sf_dir)))


def refined_columns() -> list[Column]:
    return cols("vehicle_id", "trip_id", "timestep_time", "solved", "reason", speed="vehicle_speed", accel="vehicle_accel", odometer="vehicle_odometer")


@query()
def qp_refine_stage1(spark, sf_dir):
    return refine.refine_stage_one(slow_trips(spark, sf_dir)).select(*refined_columns())


@query()
def qp_refine_with_gaps(spark, sf_dir):
    """Stage one with room to the vehicles ahead and behind."""
    return refine.refine_stage_one(slow_trips(spark, sf_dir, near(spark, sf_dir))).select(*refined_columns())


@query()
def qp_refine_stage2(spark, sf_dir):
    rows, env = slow_trips(spark, sf_dir), fx(spark, sf_dir, "fx_jerk_env")
    bad = envelope.bad_cases(envelope.jerk_points(rows, env))
    return refine.refine_stage_two(rows, bad, env).select(*refined_columns(), r6(F.col("gap")).alias("gap"))


@query(with_traj("""select vehicle_id, cast(trip_id as bigint) as trip_id, solved, round(case when solved then v0 + a1 else v1 end, 4) + 0e0 as second_speed, round(case when solved then v3 else v2 end, 4) + 0e0 as third_speed
from (select *, abs(a1) <= 4 and abs(a2) <= 4 and abs(a2 - a1) <= 4 and abs(a2) <= 4 and v0 + a1 between 0 and 20 and v0 <= 20 and v3 <= 20 as solved
  from (select *, v3 - v0 - a1 as a2 from (select *, v1 + v2 - v0 - v3 as a1 from (
    select vehicle_id, tid as trip_id, count(*) as n, max(v) filter (where i = 0) as v0, max(v) filter (where i = 1) as v1, max(v) filter (where i = 2) as v2, max(v) filter (where i = 3) as v3
    from (select vehicle_id, tid, vehicle_speed * 0.2e0 as v, row_number() over (partition by vehicle_id, tid order by timestep_time) - 1 as i from ids)
    group by 1, 2) where n = 4 and v1 > 0 and v2 > 0)))""", _TRIPS))
def qp_refine_four_rows(spark, sf_dir):
    """Trips of four rows that don't stop inside: places, speeds and the end leave one profile, if any."""
    out = refine.refine_stage_one(slow_trips(spark, sf_dir).withColumn("given", F.col("vehicle_speed")))
    w = kinematics.by_time("vehicle_id", "trip_id")
    out = out.withColumn("i", F.row_number().over(w) - 1)
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    short = out.groupBy("vehicle_id", "trip_id").agg(
        F.count("*").alias("n"), F.max("solved").alias("solved"), at("given", 1).alias("one"), at("given", 2).alias("two"),
        *[(F.round(at("vehicle_speed", i), 4) + 0.0).alias(c) for i, c in ((1, "second_speed"), (2, "third_speed"))],
    )
    return short.where("n = 4 and one > 0 and two > 0").select("vehicle_id", "trip_id", "solved", "second_speed", "third_speed")
