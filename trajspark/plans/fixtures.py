"""Trajectory tables projected from the star-schema test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"fx_traj": ["events"], "fx_lanes": ["nation"], "fx_links": ["fx_lanes"], "fx_ef": ["part"], "fx_gt": ["orders"], "fx_jerk_env": ["part"]}

SQL = {
    "fx_traj": """
select cast(user_id as string) as vehicle_id,
       cast(rn - 1 as double) as timestep_time,
       case when event_type = 'error' then 0.0e0 else value / 10.0e0 end as vehicle_speed,
       case event_type when 'click' then 'sedan' when 'view' then 'mpv_3' when 'purchase' then 'Truck_4'
                       when 'signup' then 'bus' else 'MPV' end as vehicle_type,
       concat('e', cast(cast(floor((event_id % 25) / 3) as int) as string), '_', cast((event_id % 25) % 3 as string)) as vehicle_lane,
       cast((event_id * 37) % 400 as double) / 10.0e0 as vehicle_pos,
       cast(rn - 1 as double) * 5.0e0 + cast((event_id * 13) % 200 as double) / 10.0e0 as vehicle_x,
       cast((event_id * 29) % 400 as double) / 10.0e0 - 73.0e0 as vehicle_y,
       event_id
from (select e.*, row_number() over (partition by user_id order by ts, event_id) as rn from {events} e) s
""",
    "fx_lanes": """
select concat('e', cast(cast(floor(n_nationkey / 3) as int) as string), '_', cast(n_nationkey % 3 as string)) as lane_id,
       cast(20 + (n_nationkey * 7) % 30 as double) as length, n_nationkey as k from {nation}
""",
    "fx_links": """
select a.lane_id, b.lane_id as next_lane_id from {fx_lanes} a join {fx_lanes} b
  on b.k = a.k + 1 or b.k = a.k + 5
""",
    "fx_ef": """
select t.vehicle_type, p.pollutant, v.i as speed_kmh, a.i - 20 as accel_d10,
       p.g * t.f * (v.price * 1.0917313e-3) * (1.0e0 + cast(v.i as double) * 0.01e0 + cast(greatest(a.i - 20, 0) as double) * 0.02e0) as EmissionFactor_gs
from (select 'sedan' as vehicle_type, 1.0e0 as f union all select 'MPV', 1.5e0 union all select 'truck', 3.0e0) t
cross join (select 'NOx' as pollutant, 1.0e-3 as g union all select 'PM2.5', 1.0e-4 union all select 'CO', 2.0e-3) p
cross join (select cast(row_number() over (order by p_partkey) - 1 as int) as i, p_retailprice as price from {part}) v
cross join (select cast(row_number() over (order by p_partkey) - 1 as int) as i from {part}) a
where v.i <= 140 and a.i <= 120 and not (t.vehicle_type = 'truck' and v.i > 120)
""",
    "fx_gt": """
select cast(o_custkey as string) as id, cast(rn - 1 as double) as time,
       cast((o_orderkey * 17) % 600 as double) / 10.0e0 as speed_kmh,
       case o_orderpriority when '1-URGENT' then '小轿车' when '2-HIGH' then 'MPV商务车' when '3-MEDIUM' then '厢式货车'
            when '4-NOT SPECIFIED' then 'mpv' else 'unknown' end as class,
       cast(rn - 1 as double) * 15.0e0 as coord_x, -50.0e0 as coord_y, o_orderkey
from (select o.*, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from {orders} o) s
""",
    "fx_jerk_env": """
select i - 41 as accel_d10, -3.0e0 - cast(i - 41 as double) * 0.04e0 as jerk_min, 3.0e0 - cast(i - 41 as double) * 0.04e0 as jerk_max
from (select cast(row_number() over (order by p_partkey) - 1 as int) as i from {part}) s where i <= 82
""",
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{t: fx(spark, sf_dir, t) for t in TABLES[name]})


def ctes(*names: str) -> str:
    """`fx_a as (...), fx_b as (...)` for DuckDB."""
    return ",\n".join(f"{n} as ({SQL[n].format(**{t: t for t in TABLES[n]})})" for n in names)
