from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark.functions import expr, schema
from trajspark.operators import envelope, groundtruth, interpolation, kinematics, neighbors, refine, smoothing, spatial, topology, trips


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def one_vehicle(spark, speeds, **more):
    rows = [("a", float(t), float(v)) for t, v in enumerate(speeds)]
    return frame(spark, rows, "vehicle_id string, timestep_time double, vehicle_speed double").withColumns(
        {k: F.lit(v) for k, v in more.items()}
    )


def test_trip_relabel_by_hand(spark):
    got = trips.trip_segments(one_vehicle(spark, [1, 1, 0, 1, 0, 0, 2])).orderBy("timestep_time").toPandas()
    assert got["seg"].tolist() == [1, 1, 2, 3, 4, 4, 5]
    assert got["segment"].tolist() == [1, 1, 3, 3, 3, 5, 5]


@pytest.mark.parametrize("seed", range(5))
def test_trip_relabel_like_the_loop(spark, seed):
    speeds = np.random.default_rng(seed).integers(0, 2, 40)
    seg = np.cumsum(np.r_[1, speeds[1:] != speeds[:-1]]).tolist()
    new = list(seg)
    for s in sorted({x for x, v in zip(seg, speeds, strict=True) if v}):
        at = [i for i, x in enumerate(seg) if x == s]
        for i in (at[0] - 1, at[-1] + 1):
            if 0 <= i < len(seg):
                new[i] = s
    got = trips.trip_segments(one_vehicle(spark, speeds)).orderBy("timestep_time").toPandas()
    assert got["segment"].tolist() == new


def test_strict_asof_with_ties(spark):
    left = frame(spark, [(1, 1.5, "p"), (1, 2.0, "q"), (1, 2.5, "r")], "k int, at double, tie string")
    right = frame(spark, [(1, 1.0, "a"), (1, 2.0, "b"), (1, 2.0, "c"), (1, 3.0, "d")], "k int, at double, tie string")
    right = right.withColumn("name", F.col("tie"))
    ahead = neighbors.asof_strict(left, right, ["k"], "at", ["name"], True, "n_", "tie").orderBy("at").toPandas()
    behind = neighbors.asof_strict(left, right, ["k"], "at", ["name"], False, "n_", "tie").orderBy("at").toPandas()
    assert ahead["n_name"].tolist() == ["b", "d", "d"]
    assert behind["n_name"].tolist() == ["a", "a", "c"]


def test_asof_like_pandas(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.integers(0, 5, 200), "at": rng.permutation(1000)[:200].astype(float)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 200), "at": rng.permutation(1000)[:200].astype(float)})
    left["tie"], right["tie"] = left.index.astype(str), right.index.astype(str)
    right["name"] = right["tie"]
    got = neighbors.asof_strict(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", ["name"], True, "n_", "tie").toPandas()
    expected = pd.merge_asof(left.sort_values("at"), right.sort_values("at")[["k", "at", "name"]], on="at", by="k", direction="forward", allow_exact_matches=False)
    assert dict(zip(got["tie"], got["n_name"].fillna(""), strict=True)) == dict(zip(expected["tie"], expected["name"].fillna(""), strict=True))


def test_interpolation_clamps_and_fits(spark):
    base = frame(spark, [("a", 0.0, 0.0, 10.0, 1.0), ("a", 1.0, 1.0, 20.0, 3.0)], "vehicle_id string, timestep_time double, vehicle_odometer double, vehicle_x double, vehicle_y double")
    queries = frame(spark, [("a", float(i), o, None, None) for i, o in enumerate([-5.0, 0.0, 0.25, 1.0, 99.0])], base.schema)
    got = interpolation.fill_xy(queries, base).orderBy("timestep_time").toPandas()
    assert got["vehicle_x"].tolist() == [10, 10, 12.5, 20, 20]
    assert got["vehicle_y"].tolist() == [1, 1, 1.5, 3, 3]


def test_half_even(spark):
    got = frame(spark, [(x,) for x in (0.25, 0.35, 0.15, 1.05, 0.45, -0.01)], "x double").select(expr.half_even(F.col("x"), 1).alias("y"))
    assert [r.y for r in got.collect()] == pytest.approx([0.2, 0.4, 0.2, 1.0, 0.4, 0.0])


def test_smoothing_windows():
    assert [smoothing.window_for(n) for n in range(1, 15)] == [0, 0, 0, 0, 5, 5, 7, 7, 9, 9, 11, 11, 11, 11]
    middle = smoothing.coefficients(11, 2)[5] * 429
    assert middle == pytest.approx([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])


def test_smoothing_like_a_loop(spark):
    v = np.abs(np.random.default_rng(5).normal(5, 2, 30))
    odo = np.r_[0, np.cumsum((v[1:] + v[:-1]) / 2)]
    rows = [("a", 1, float(t), float(x), float(o)) for t, (x, o) in enumerate(zip(v, odo, strict=True))]
    df = frame(spark, rows, "vehicle_id string, trip_id long, timestep_time double, vehicle_speed double, vehicle_odometer double")
    got = smoothing.smooth_trips(df).orderBy("timestep_time").toPandas()
    c, n = smoothing.coefficients(11, 2), len(v)
    s = np.array([c[i] @ v[:11] if i < 5 else c[i - n + 11] @ v[-11:] if i >= n - 5 else c[5] @ v[i - 5 : i + 6] for i in range(n)]).clip(0, 60)

    def again(s):
        a = np.r_[np.diff(s), 0].clip(-10, 10)
        return np.r_[s[0], s[0] + np.cumsum(a[:-1])].clip(0, 60), a

    r, a = again(s)
    distance = ((r[1:] + r[:-1]) / 2).sum()
    r[1:-1] *= odo[-1] / distance
    r, a = again(r.clip(0, 60))
    assert got["speed"].to_numpy() == pytest.approx(r)
    assert got["accel"].to_numpy() == pytest.approx(a)


def test_clipped_speed_like_the_loop(spark):
    a = np.random.default_rng(7).normal(0, 2, 50)
    rows = [("a", float(t), float(x)) for t, x in enumerate(a)]
    df = frame(spark, rows, "vehicle_id string, timestep_time double, vehicle_accel double")
    got = kinematics.clipped_speed(df, 1.0).orderBy("timestep_time").toPandas()["vehicle_speed"]
    v = [1.0]
    for x in a[1:]:
        v.append(max(0.0, v[-1] + x))
    assert got.to_numpy() == pytest.approx(v)


def test_polygon(spark):
    polygon = expr.parse_polygon("29,-45;388,-38;388,-70;29,-73")
    got = frame(spark, [(100.0, -60.0), (0.0, 0.0)], "x double, y double").select(expr.in_polygon(F.col("x"), F.col("y"), polygon).alias("i"))
    assert [r.i for r in got.collect()] == [True, False]
    assert expr.parse_polygon("1,2;3") == [] and expr.parse_polygon(None) == [] and expr.parse_polygon("1,2;3,4") == []


def test_bins_like_metres(spark):
    rng = np.random.default_rng(11)
    rows = [("d", str(k), float(t), float(rng.uniform(-50, 300)), float(rng.uniform(0, 2))) for k in range(20) for t in range(20)]
    df = frame(spark, rows, "data_type string, vehicle_id string, timestep_time double, x double, NOx_gs double")
    parts = [f(df, "x", ["NOx_gs"], 20.0, 29.0).orderBy("axis_bin").toPandas() for f in (spatial.spatial_by_bin, spatial.spatial_by_metre)]
    assert parts[0]["axis_bin"].tolist() == parts[1]["axis_bin"].tolist()
    assert parts[0]["NOx_g"].to_numpy() == pytest.approx(parts[1]["NOx_g"].to_numpy())


def test_paths_stop_at_cycles(spark):
    links = frame(spark, [("s", "a"), ("a", "b"), ("b", "a"), ("b", "t")], "lane_id string, next_lane_id string")
    got = {tuple(r.path) for r in topology.lane_paths(links).collect()}
    assert got == {("s", "a", "b", "t"), ("s", "a", "b")}  # a way back to a ends one path at b, the other link goes on
    loop = frame(spark, [("s", "a"), ("a", "b"), ("b", "a")], "lane_id string, next_lane_id string")
    assert {tuple(r.path) for r in topology.lane_paths(loop).collect()} == {("s", "a", "b")}


def test_via_lanes_make_two_links(spark):
    rows = frame(spark, [("e1", "e2", "0", "1", ":j_0"), ("e2", "e3", "0", "0", None)], "`from` string, to string, fromLane string, toLane string, via string")
    got = {(r.lane_id, r.next_lane_id) for r in topology.lane_links(rows).collect()}
    assert got == {("e1_0", ":j_0"), (":j_0", "e2_1"), ("e2_0", "e3_0")}


def test_overwrite_together_or_each(spark):
    base = frame(spark, [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0)], "k int, a double, b double")
    new = frame(spark, [(1, 5.0, None), (2, 5.0, 6.0)], "k int, a double, b double")
    each = envelope.overwrite(base, new, ["k"], ["a", "b"]).orderBy("k").collect()
    both = envelope.overwrite(base, new, ["k"], ["a", "b"], together=True).orderBy("k").collect()
    assert [tuple(r) for r in each] == [(1, 5, 1), (2, 5, 6), (3, 1, 1)]
    assert [tuple(r) for r in both] == [(1, 1, 1), (2, 5, 6), (3, 1, 1)]


def test_aliases_take_pairs_and_any_case(spark):
    df = frame(spark, [("1", "2", "3", "bad", "v")], "`Coord X` string, coord_y string, X string, Speed string, ID string")
    got = schema.resolve(df, schema.GT_ALIASES, paired=True, fold=True).first()
    assert (got.vehicle_x, got.vehicle_y, got.vehicle_speed, got.vehicle_id, got.vehicle_jerk) == (1.0, 2.0, None, "v", None)
    assert schema.pollutant_column(["time", "PM2.5_gs"], "pm2.5") == "PM2.5_gs"
    with pytest.raises(ValueError):
        schema.pollutant_column(["NOx_gs"], "CO")
    assert schema.safe_name(" a b/c ") == "a_b_c" and schema.safe_name("//") == "fcd"


def test_paths_without_entry_lane(spark):
    columns = "lane_id string, next_lane_id string"
    ring = frame(spark, [("a", "b"), ("b", "c"), ("c", "a")], columns)
    assert {tuple(r.path) for r in topology.lane_paths(ring).collect()} == {("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")}
    exits = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "x")], columns)
    assert {tuple(r.path) for r in topology.lane_paths(exits).collect()} == {("b", "c", "a"), ("b", "x"), ("x",)}


def test_paths_like_a_search(spark):
    """All paths of random graphs with cycles, against a search lane by lane."""
    for seed in range(4):
        r = np.random.default_rng(seed)
        links = sorted({(f"l{a}", f"l{b}") for a, b in r.integers(0, 7, (11, 2)) if a != b})
        ways: dict[str, list[str]] = {}
        for a, b in links:
            ways.setdefault(a, []).append(b)
        lanes = sorted({x for pair in links for x in pair})
        n_in = {x: sum(b == x for _, b in links) for x in lanes}
        starts = [x for x in lanes if not n_in[x]] or [x for x in lanes if (n_in[x], len(ways.get(x, []))) != (1, 1)] or lanes
        expected, open_ways = set(), [(s,) for s in starts]
        while open_ways:
            path = open_ways.pop()
            new = [n for n in ways.get(path[-1], []) if n not in path]
            if len(new) < len(ways.get(path[-1], [])) or not new:
                expected.add(path)
            open_ways += [(*path, n) for n in new]
        got = [tuple(x.path) for x in topology.lane_paths(frame(spark, links, "lane_id string, next_lane_id string")).collect()]
        assert sorted(got) == sorted(expected)


def test_paths_beyond_a_recursions_rows(spark):
    """A ladder of 17 steps has 2^17 ways of 18 lanes: far more rows than one recursive query may have."""
    links = [(f"{k}{a}", f"{k + 1}{b}") for k in range(17) for a in "xy" for b in "xy"] + [("s", "0x")]
    paths = topology.lane_paths(frame(spark, links, "lane_id string, next_lane_id string"), hops=6).where("path[0] = 's'")
    assert tuple(paths.agg(F.count("*"), F.count_if("cut"), F.min(F.size("path")), F.count_distinct("path")).first()) == (1 << 17, 0, 19, 1 << 17)


def test_cut_paths_are_marked(spark):
    links = spark.createDataFrame([(f"l{k}", f"l{k + 1}") for k in range(300)], "lane_id string, next_lane_id string")
    assert [(len(r.path), r.cut) for r in topology.lane_paths(links, hops=60).collect()] == [(301, False)]
    fork = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("d", "f")], "lane_id string, next_lane_id string")
    got = {("".join(r.path), r.cut) for r in topology.lane_paths(fork, max_paths=2, hops=2).collect()}
    assert got == {("ac", False), ("abd", True), ("abe", True)}


def test_path_table_by_hand(spark):
    """Two lanes of edge a lead to b by an internal lane: one path; a flow from a to b is the larger of two."""
    links = spark.createDataFrame([("a_0", ":j_0"), ("a_1", ":j_0"), (":j_0", "b_0"), ("b_0", None)], "lane_id string, next_lane_id string")
    lengths = spark.createDataFrame([("a_0", 5.0), ("a_1", 6.0), (":j_0", 1.0), ("b_0", 10.0)], "lane_id string, length double")
    flows = spark.createDataFrame([("f", "a", "b", 1.0), ("g", "a", "b", 2.0)], "flow_id string, from_edge string, to_edge string, vehs_per_hour double")
    compact = topology.compact_paths(topology.lane_paths(links), lengths)
    rows = topology.path_table(compact, links, flows).collect()
    assert [r.path_no for r in rows] == [0]
    assert [(r.signature, r.path_len, r.n_edges, r.strict_start, r.strict_end, r.from_edge, r.to_edge, r.flow_id) for r in rows] == [
        ("a>:j_0>b", 16.0, 3, True, True, "a", "b", "g")
    ]
    assert topology.path_table(compact.limit(0), links, flows).collect() == []


def test_reports_and_sample(spark):
    rows = spark.createDataFrame([("a", 0.0, 80.0), ("a", 1.0, 80.0), ("a", 1.0, 80.0), ("b", 0.0, 80.0), ("b", 3.0, 80.0), (None, 0.0, 1.0)], "vehicle_id string, timestep_time double, vehicle_speed double")
    assert tuple(kinematics.dt_report(rows).first()) == (1.0, 2.0, 3.0, 1)
    assert tuple(kinematics.dt_report(rows.limit(0)).first()) == (None, None, None, 0)
    one = kinematics.sample_vehicles(rows, 1, seed=3)
    assert one.count() in (2, 3) and one.select("vehicle_id").distinct().count() == 1
    assert kinematics.sample_vehicles(rows, 9).count() == 5
    warned = lambda unit: groundtruth.speed_report(rows, unit).first().warning
    assert "above 60" in warned("mps") and warned("mph") is None and "unknown unit" in warned("knots")
    assert "below 10" in groundtruth.speed_report(rows.withColumn("vehicle_speed", F.lit(2.0)), "kmh").first().warning
