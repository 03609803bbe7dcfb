"""Refinement: feasibility, places, optima against slow solvers, long trips, the envelope, reasons."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from trajspark.operators import chain_qp, neighbors, refine

LIMITS = refine.Limits()


def profile(seed: int, n: int = 40) -> np.ndarray:
    v = np.abs(np.random.default_rng(seed).normal(3, 2, n))
    v[0] = v[-1] = v[n // 2] = 0
    return v


def gone(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((v[:-1] + v[1:]) / 2)])


def dense_qp(p, q, a, low, high, rounds=200_000, rho=1.0):
    """Minimises x'Px/2 + q'x with low <= Ax <= high by operator splitting with dense matrices."""
    n, r = len(q), np.where(low == high, 1e3, 1.0) * rho
    inverse = np.linalg.inv(p + 1e-6 * np.eye(n) + (a.T * r) @ a)
    x, z, y = np.zeros(n), np.clip(np.zeros(len(low)), low, high), np.zeros(len(low))
    for k in range(rounds):
        x = inverse @ (1e-6 * x - q + a.T @ (r * z - y))
        new = np.clip(a @ x + y / r, low, high)
        y, z = y + r * (a @ x - new), new
        if k % 50 == 49 and np.abs(a @ x - z).max() < 1e-9 and np.abs(p @ x + q + a.T @ y).max() < 1e-8:
            break
    return x


def dense_stage_one(v0, limits, ahead=None, behind=None, safe=0.0):
    """Accelerations of stage one from its definition, all rows against all columns."""
    n = len(v0)
    total = np.tril(np.ones((n, n)))
    total[:, 0] = 0  # a_0 moves nothing
    place = np.zeros((n, n))
    place[1:] = np.cumsum((total[:-1] + total[1:]) / 2, axis=0)
    still = gone(np.full(n, v0[0]))
    lock = (v0 == 0) | (np.arange(n) == 0) | (np.arange(n) == n - 1)
    x0 = gone(v0)
    step = np.diff(np.eye(n), axis=0)
    ends = np.eye(n)[[0, n - 1]]
    rows = [total, place[lock], np.eye(n), step, ends]
    low = [np.where(lock, v0, 0) - v0[0], (x0 - still)[lock], np.full(n, -limits.a_max), np.full(n - 1, -limits.max_step), np.zeros(2)]
    high = [np.where(lock, v0, limits.v_max) - v0[0], (x0 - still)[lock], np.full(n, limits.a_max), np.full(n - 1, limits.max_step), np.zeros(2)]
    if ahead is not None:
        at = np.isfinite(ahead)
        rows.append((place + 0.1 * total)[at])
        low.append(np.full(at.sum(), -np.inf))
        high.append((x0 + ahead - safe - still - 0.1 * v0[0])[at])
    if behind is not None:
        at = np.isfinite(behind)
        rows.append(place[at])
        low.append((x0 - behind + safe + 0.1 * limits.v_max - still)[at])
        high.append(np.full(at.sum(), np.inf))
    p = 2 * (limits.w_accel * np.eye(n) + limits.w_speed * total.T @ total + limits.w_place * place.T @ place)
    q = -2 * limits.w_speed * total.T @ (v0 - v0[0]) - 2 * limits.w_place * place.T @ (x0 - still)
    return dense_qp(p, q, np.vstack(rows), np.concatenate(low), np.concatenate(high))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_block_tridiagonal_systems(n):
    r = np.random.default_rng(n)
    d, low = r.normal(size=(n, 3, 3)), r.normal(size=(n, 3, 3))
    d, low[0] = d + d.transpose(0, 2, 1) + 9 * np.eye(3), 0
    full = np.zeros((3 * n, 3 * n))
    for i in range(n):
        full[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = d[i]
        if i:
            full[3 * i : 3 * i + 3, 3 * i - 3 : 3 * i] = low[i]
            full[3 * i - 3 : 3 * i, 3 * i : 3 * i + 3] = low[i].T
    b = r.normal(size=(n, 3))
    assert np.allclose(chain_qp.Tridiagonal(d, low).solve(b).ravel(), np.linalg.solve(full, b.ravel()))


@pytest.mark.parametrize("seed", range(8))
def test_stage_one_is_feasible_and_keeps_places(seed):
    v = profile(seed)
    a = refine.stage_one(v, LIMITS)
    s = v[0] + np.cumsum(a)
    assert np.abs(a).max() <= LIMITS.a_max + 1e-5 and np.abs(np.diff(a)).max() <= LIMITS.max_step + 1e-5
    assert s.min() > -1e-5 and a[0] == a[-1] == 0
    for row in (0, 20, 39):
        assert s[row] == pytest.approx(v[row], abs=1e-5) and gone(s)[row] == pytest.approx(gone(v)[row], abs=1e-3)


@pytest.mark.parametrize(("seed", "w_place"), [(0, 0.0), (1, 0.0), (1, 0.5), (2, 0.0), (3, 2.0)])
def test_stage_one_optimum(seed, w_place):
    limits = refine.Limits(w_place=w_place)
    v = profile(seed, 16)
    x = gone(v)
    ahead = np.where(np.arange(16) % 3 == 1, 3.0, np.nan)
    behind = np.where(np.arange(16) % 4 == 2, 5.5, np.nan)
    for gaps in ((None, None, 0.0), (ahead, behind, 1.0)):
        a = refine.stage_one(v, limits, *gaps)
        b = dense_stage_one(v, limits, *gaps)

        def cost(acc):
            s = v[0] + np.cumsum(acc)
            return 5 * (acc**2).sum() + ((s - v) ** 2).sum() + w_place * ((gone(s) - x) ** 2).sum()

        if a is None:  # then the slow solver's result breaks a limit
            s = v[0] + np.cumsum(b)
            assert min(np.nanmin(x + ahead - gone(s) - 1.0 - 0.1 * s), np.nanmin(gone(s) - x + behind - 3.0), -np.abs(gone(s) - x)[-1]) < -1e-5
            assert gaps[0] is not None
            continue
        assert cost(a) == pytest.approx(cost(b), rel=1e-4)
        assert np.abs(a - b).max() < 1e-2


def test_weight_of_places():
    v = profile(4)
    off = [np.abs(gone(v[0] + np.cumsum(refine.stage_one(v, refine.Limits(w_place=w)))) - gone(v)).max() for w in (0.0, 50.0)]
    assert off[1] < off[0] / 2


def test_long_trip():
    """A trip of 20,000 rows in one task: linear time and memory."""
    r = np.random.default_rng(0)
    v = np.convolve(np.abs(np.cumsum(r.normal(0, 0.5, 20_008))) % 15, np.ones(9) / 9, "valid")
    began = time.perf_counter()
    t = refine._one(v, None, None, None, 0.0)
    speed, place, _, reason = refine.first_stage(t, LIMITS)
    assert reason[0] is None and time.perf_counter() - began < 30
    assert place[-1] == pytest.approx(t.x0[-1]) and np.abs(place - refine.unit_places(speed, t.first)).max() < 1e-3


def test_trips_solved_together_are_those_solved_alone():
    profiles = [profile(k, 5 + k) for k in range(12)]
    v = np.concatenate(profiles)
    first = np.concatenate([np.arange(len(p)) == 0 for p in profiles])
    none = np.full(len(v), np.nan)
    _, _, a, reason = refine.first_stage(refine.Trips(first, v, refine.unit_places(v, first), none, none), LIMITS)
    for k, (p, i) in enumerate(zip(profiles, np.flatnonzero(first), strict=True)):
        alone = refine.stage_one(p, LIMITS)
        assert (alone is None) == (reason[k] is not None)
        if alone is not None:
            assert np.abs(alone - a[i : i + len(p)]).max() < 1e-3


@pytest.mark.parametrize("seed", range(2))
def test_stage_one_keeps_room(seed):
    """The vehicle ahead stands still: without the limit the profile would come too near."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([[4.0], 4 + rng.uniform(0, 2, 10), [4.0]])
    x, safe = gone(v), 2.0
    ahead, behind = np.full(len(v), np.nan), np.full(len(v), np.nan)
    free = v[0] + np.cumsum(refine.stage_one(v, LIMITS))
    ahead[5:9] = gone(free)[8] + 1.0 - x[5:9]  # 1 m left in row 8 without the limit
    s = v[0] + np.cumsum(refine.stage_one(v, LIMITS, ahead, behind, safe))
    left = lambda s: ((x + ahead - gone(s)) - safe - 0.1 * s)[5:9]
    assert left(free).min() < 0 and left(s).min() > -1e-4 and gone(s)[-1] == pytest.approx(x[-1])
    behind[:] = 1.0  # nearer than the least room to the vehicle behind, in the first row already
    assert refine.stage_one(v, LIMITS, ahead, behind, safe) is None


def test_programmes_without_solution():
    reason = lambda v: refine.first_stage(refine._one(v, None, None, None, 0.0), LIMITS)[3][0]
    assert reason([50.0, 0.0]) == "locked row breaks a limit"
    assert reason([0.0, 9.0, 9.0]) == "out of reach"
    assert reason([0.0, 30.0, 0.0, 30.0, 0.0]) == "infeasible"  # 30 m between two stops of two seconds
    assert reason([1.0]) == "one row"
    assert reason([0.0, 1.0, 1.0, 1.0, 0.5, 0.0, 0.0]) is None


# ---- second stage

KNOTS = np.array([-4.0, -1.0, 0.0, 1.5, 4.0])
#: narrow jerks near no acceleration, wide ones away from it
BOTH = np.c_[KNOTS, [-1.6, -1.1, -0.5, -1.4, -4.5], [4.1, 1.2, 0.5, 0.75, 0.6]]


@pytest.mark.parametrize("seed", range(6))
def test_stage_two_is_the_best_of_all_pieces(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 6))
    v = np.abs(5 + np.cumsum(rng.normal(0, 1.5, n)))
    limits = refine.Limits(nodes=5000, mip_gap=1e-7)
    t, env = refine._one(v, None, None, None, 0.0), refine.Envelope(BOTH, limits.a_max)
    speed, place, a, reason, gap = refine.second_stage(t, env, limits)
    best = np.inf
    for pieces in itertools.product(range(env.pieces), repeat=n - 1):
        low = np.array([*pieces, 0])
        _, outcome, cost = refine._relaxed(t, low, low + 1, env, limits)
        best = min(best, cost[0] if outcome[0] == chain_qp.SOLVED else np.inf)
    assert (reason[0] is None) == np.isfinite(best)
    if np.isfinite(best):
        assert 5 * (a**2).sum() + ((speed - v) ** 2).sum() == pytest.approx(best, rel=1e-5) and gap[0] <= 1e-6
        assert env.outside(a[:-1], np.diff(a)).max() <= 1e-4 and place[-1] == pytest.approx(t.x0[-1])


def test_stage_two_needs_more_than_the_hull():
    """Where the convex hull isn't enough the search branches; with few nodes the gap tells what isn't proven."""
    v = np.array([0.0, 2.0, 5.0, 7.0, 8.0, 8.0, 7.0, 4.0, 2.0, 0.5, 0.0])
    few, many = refine.stage_two(v, BOTH, refine.Limits(nodes=6)), refine.stage_two(v, BOTH, refine.Limits(nodes=3000))
    assert many is not None and many[2] <= 1e-4
    if few is not None:
        cost = lambda r: 5 * (r[1] ** 2).sum() + ((r[0] - v) ** 2).sum()
        assert cost(few) >= cost(many) - 1e-4 and (cost(few) - cost(many)) / cost(few) <= few[2] + 1e-4


def test_stage_two_keeps_room_and_stops():
    env = np.array([[x / 10, -3 - 0.04 * x, 3 - 0.04 * x] for x in range(-41, 42)])
    v = np.abs(np.random.default_rng(2).normal(3, 0.5, 30))
    v[15:17] = 0
    v[[13, 14, 17, 18]] = [2.0, 0.8, 0.8, 2.0]
    found = refine.stage_two(v, env, LIMITS)
    assert found is not None
    speed, accel, _ = found
    assert speed[15:17].max() < 1e-5 and speed.min() >= 0
    j = np.diff(accel)
    assert (j >= np.interp(accel[:-1], env[:, 0], env[:, 1]) - 1e-4).all() and (j <= np.interp(accel[:-1], env[:, 0], env[:, 2]) + 1e-4).all()
    place = lambda r: np.append(0, np.cumsum(r[0][:-1] + r[1][:-1] / 3 + r[1][1:] / 6))
    ahead = np.full(30, np.nan)
    ahead[8] = place(found)[8] - gone(v)[8] + 2.0 + 0.1 * speed[8] - 0.05  # 5 cm nearer than it may be without the limit
    kept = refine.stage_two(v, env, LIMITS, ahead, np.full(30, np.nan), 2.0)
    assert kept is not None and gone(v)[8] + ahead[8] - place(kept)[8] >= 2.0 + 0.1 * kept[0][8] - 1e-4


# ---- on tables


def test_refined_trips_are_marked(spark):
    rows = [("a", 0, float(t), v, 0.0, None, None) for t, v in enumerate([1.0, 2.0, 2.5, 2.0, 1.0])]
    rows += [("b", 0, float(t), v, 0.0, 0.5, None) for t, v in enumerate([10.0, 11.0, 10.0])]
    rows += [("c", 0, 0.0, 0.0, 0.0, None, None), ("c", 1, 1.0, 2.0, 0.0, None, None), ("d", 0, 0.0, None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "vehicle_id string, trip_id long, timestep_time double, vehicle_speed double, vehicle_accel double, following_headway_distance double, preceding_headway_distance double")
    out = refine.refine_stage_one(df)
    got = {(r.vehicle_id, r.trip_id, r.solved, r.reason) for r in out.collect()}
    assert got == {
        ("a", 0, True, None), ("b", 0, False, "locked row breaks a limit"), ("c", 0, False, "not moving"), ("c", 1, False, "one row"), ("d", 0, False, "no speed"),
    }
    assert out.columns == [*df.columns, "vehicle_odometer", "solved", "reason"] and out.count() == len(rows)


@pytest.mark.parametrize("together", [1, 50, 20_000])
def test_trips_keep_their_length_on_tables(spark, monkeypatch, together):
    monkeypatch.setattr(refine, "TOGETHER", together)
    ramp = [*np.arange(0, 12, 1.5), *[12.0] * 20, *np.arange(12, -0.1, -1.5)]
    rows = [(f"v{k}", k % 3, float(t), float(v), 0.0, float(100 + x)) for k in range(40) for t, (v, x) in enumerate(zip(ramp, gone(np.array(ramp)), strict=True))]
    df = spark.createDataFrame(rows, "vehicle_id string, trip_id long, timestep_time double, vehicle_speed double, vehicle_accel double, vehicle_odometer double")
    out = refine.refine_stage_one(df).toPandas().sort_values(["vehicle_id", "timestep_time"])
    assert out.solved.all() and len(out) == len(rows)
    for _, trip in out.groupby("vehicle_id"):
        assert trip.vehicle_odometer.iloc[0] == pytest.approx(100) and trip.vehicle_odometer.iloc[-1] == pytest.approx(100 + gone(np.array(ramp))[-1])
        assert np.abs(gone(trip.vehicle_speed.to_numpy()) + 100 - trip.vehicle_odometer.to_numpy()).max() < 1e-3


def test_second_stage_on_tables(spark):
    env = spark.createDataFrame([(int(round(a * 10)), float(lo), float(hi)) for a, lo, hi in BOTH], "accel_d10 int, jerk_min double, jerk_max double")
    v = [0.0, 2.0, 5.0, 7.0, 8.0, 8.0, 7.0, 4.0, 2.0, 0.5, 0.0]
    rows = [(n, 0, float(t), s, 0.0, 9.0) for n in ("bad", "good") for t, s in enumerate(v)]
    df = spark.createDataFrame(rows, "vehicle_id string, trip_id long, timestep_time double, vehicle_speed double, vehicle_accel double, vehicle_jerk double")
    bad = spark.createDataFrame([("bad", 0)], "vehicle_id string, trip_id long")
    out = refine.refine_stage_two(df, bad, env, refine.Limits(nodes=2000)).toPandas().sort_values(["vehicle_id", "timestep_time"])
    one, other = out[out.vehicle_id == "bad"], out[out.vehicle_id == "good"]
    assert one.solved.all() and one.gap.max() <= 1e-4 and not other.solved.any() and other.vehicle_speed.tolist() == v and (other.vehicle_jerk == 9).all()
    assert np.abs(np.diff(one.vehicle_accel) - one.vehicle_jerk.to_numpy()[:-1]).max() < 1e-6


@pytest.mark.parametrize("odd", [[1.0, 1e200, 1.0], [1.0, np.nan, 1.0, 2.0], [1.0, np.inf, 1.0], [1.0, 1e306, 1e306, 1.0]])
def test_a_trip_beyond_all_numbers_spoils_no_other(odd):
    profiles = [profile(k, 5 + k) for k in range(12)]
    env = refine.Envelope(BOTH, LIMITS.a_max)

    def solved(given):
        v = np.concatenate(given)
        first = np.concatenate([np.arange(len(p)) == 0 for p in given])
        none = np.full(len(v), np.nan)
        t = refine.Trips(first, v, refine.unit_places(v, first), none, none)
        return refine.first_stage(t, LIMITS)[3], refine.second_stage(t, env, refine.Limits(nodes=4))[3]

    for without, beside in zip(solved(profiles), solved([*profiles[:6], np.array(odd), *profiles[6:]]), strict=True):
        assert beside[6] is not None and [*beside[:6], *beside[7:]] == list(without)


def test_a_singular_block_stops_no_other(monkeypatch):
    """A task's trips come out though one's system can't be solved."""
    step = chain_qp._step

    def singular(c, *rest):
        if (np.diff(np.append(np.flatnonzero(c.first), len(c.first))) == 7).any():
            raise np.linalg.LinAlgError("Singular matrix")
        return step(c, *rest)

    monkeypatch.setattr(chain_qp, "_step", singular)
    profiles = [profile(k, 5 + k) for k in range(5)]
    v = np.concatenate(profiles)
    first = np.concatenate([np.arange(len(p)) == 0 for p in profiles])
    none = np.full(len(v), np.nan)
    reason = refine.first_stage(refine.Trips(first, v, refine.unit_places(v, first), none, none), LIMITS)[3]
    assert reason[2] == "no convergence" and all((refine.stage_one(p, LIMITS) is None) == (reason[k] is not None) for k, p in enumerate(profiles) if k != 2)


def test_vehicles_at_one_place(spark):
    """Of vehicles at one place the ties' rule chooses, whichever lane they are on."""
    lanes = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "lane_id string, length double")
    links = spark.createDataFrame([("a", "b"), ("a", "c")], "lane_id string, next_lane_id string")
    rows = [("v0", "a", 2.0), ("v9", "a", 2.0), ("v3", "b", 1.0), ("v2", "b", 1.0), ("v1", "c", 1.0), ("v4", "a", 5.0), ("v5", "a", 5.0)]
    df = spark.createDataFrame([(v, 0.0, float(k), lane, at) for k, (v, lane, at) in enumerate(rows)], "vehicle_id string, timestep_time double, vehicle_speed double, vehicle_lane string, vehicle_pos double")
    got = {r.vehicle_id: (r.following_vehicle_id, r.following_vehicle_speed, r.preceding_vehicle_id, r.preceding_vehicle_speed) for r in neighbors.neighbours(df, links, lanes).collect()}
    speed = {v: float(k) for k, (v, *_) in enumerate(rows)}
    for vehicle, ahead, behind in [("v0", "v4", None), ("v9", "v4", None), ("v4", "v1", "v9"), ("v5", "v1", "v9"), ("v2", None, "v5"), ("v1", None, "v5")]:
        assert got[vehicle] == (ahead, speed.get(ahead), behind, speed.get(behind))


def test_rows_of_a_place_are_joined_once(spark):
    """A vehicle more at a place brings one row more into the as-of windows, not one for each lane that leads there."""
    lanes = spark.createDataFrame([("a", 10.0), *[(f"b{k}", 10.0) for k in range(9)]], "lane_id string, length double")
    links = spark.createDataFrame([("a", f"b{k}") for k in range(9)], "lane_id string, next_lane_id string")
    schema = "vehicle_id string, timestep_time double, vehicle_speed double, vehicle_lane string, vehicle_pos double"
    plan = lambda n: neighbors.neighbours(spark.createDataFrame([(f"v{k}", 0.0, 1.0, "a", 2.0) for k in range(n)], schema), links, lanes)
    seen = []
    original = neighbors.asof_strict
    try:
        neighbors.asof_strict = lambda left, right, *rest: (seen.append(right.count()), original(left, right, *rest))[1]
        plan(1), plan(50)
    finally:
        neighbors.asof_strict = original
    assert seen[:2] == seen[2:]
