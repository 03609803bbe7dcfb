"""Refining the speed profile of each trip by quadratic programmes over its states (speed, place, acceleration).

Stage 1: v_t = v_{t-1} + a_t and x_t = x_{t-1} + v_{t-1} + a_t / 2; minimise 5 sum a^2 + sum (v - v0)^2, and the weighted
squares of x - x0 if asked for, subject to bounds on a and v, steps of a of at most `max_step`, and no acceleration in the
last row. In the first and last row and where the given speed is 0, speed *and place* are the given ones, so a trip keeps
its length and its stops stay where they are. Where there is a vehicle ahead, x_t stays the safe distance and 0.1 v_t
behind it; where there is one behind, the safe distance and 0.1 v_max before it.

Stage 2: v_t = v_{t-1} + a_{t-1} + j_{t-1} / 2, x_t = x_{t-1} + v_{t-1} + a_{t-1} / 2 + j_{t-1} / 6 with jerks
j_{t-1} = a_t - a_{t-1} inside an envelope that is piecewise linear in a_{t-1} and not convex, with the same locks and room.
Branch and bound: a node gives each row's acceleration a range of the envelope's knots; its relaxation takes the convex
hull of the envelope over that range, which is exact for a single piece. The row that is farthest outside the envelope is
split. Nodes of many trips are solved together. `gap` is the distance between the result's cost and the proven bound, as a
share of the cost; it is above the tolerance only where a trip ran out of nodes.

Rows of a trip count as a second apart. A trip without a solution keeps its given values and has the reason in `reason`
(null where solved): "no speed", "not moving", "one row", "locked row breaks a limit", "out of reach" (speeds between
locks need more than a_max), "infeasible" (proven), "no convergence", "no solution in the nodes allowed".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import ship, stored
from .chain_qp import INFEASIBLE, SOLVED, Chains, solve
from .kinematics import A, T, V, VID, moving_only
from .neighbors import safe_distance

KEYS = [VID, "trip_id"]
S, J = "vehicle_odometer", "vehicle_jerk"
AHEAD, BEHIND = "following_headway_distance", "preceding_headway_distance"
LOCKED, REACH, ONE_ROW = "locked row breaks a limit", "out of reach", "one row"
OUTCOMES = np.array([None, "infeasible", "no convergence"], dtype=object)
FACETS = 3
TOGETHER = 20_000  # rows that a task solves together; a longer trip is solved alone


@dataclass(frozen=True)
class Limits:
    w_accel: float = 5.0
    w_speed: float = 1.0
    w_place: float = 0.0
    a_max: float = 4.0
    v_max: float = 20.0
    max_step: float = 4.0
    tolerance: float = 1e-6
    nodes: int = 64  # relaxations a trip in stage 2
    mip_gap: float = 1e-4


@dataclass
class Trips:
    """Rows of whole trips, one after the other: first row of each, given speed and place, room ahead and behind (NaN: none)."""

    first: np.ndarray
    v0: np.ndarray
    x0: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray
    safe: float = 0.0

    @property
    def starts(self) -> np.ndarray:
        return np.flatnonzero(self.first)

    @property
    def last(self) -> np.ndarray:
        return np.append(self.first[1:], True)

    @property
    def lock(self) -> np.ndarray:
        return (self.v0 == 0) | self.first | self.last

    def take(self, rows: np.ndarray | slice) -> Trips:
        return Trips(self.first[rows], self.v0[rows], self.x0[rows], self.ahead[rows], self.behind[rows], self.safe)

    def reasons(self, limits: Limits) -> np.ndarray:
        """Why a trip can't have a solution, where that shows without solving it."""
        begin, size = self.starts, np.diff(np.append(self.starts, len(self.v0)))
        out = np.full(len(begin), None, dtype=object)
        lead, tail = self.ahead - self.safe - 0.1 * self.v0, self.behind - self.safe - 0.1 * limits.v_max
        broken = self.lock & ((self.v0 > limits.v_max) | (self.v0 < 0) | (lead < -1e-6) | (tail < -1e-6))
        # a speed between two locked rows can't leave the cones that open from them
        at, row = np.flatnonzero(self.lock), np.arange(len(self.v0))
        gap, turn = np.diff(at), np.abs(np.diff(self.v0[at]))
        far = (turn > limits.a_max * gap + 1e-9) & ~self.first[at[1:]]
        trip = np.cumsum(self.first) - 1
        out[np.unique(trip[at[1:][far]])] = REACH
        out[np.unique(trip[row[broken]])] = LOCKED
        out[size < 2] = ONE_ROW
        return out


def _room(t: Trips, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Right sides of place + 0.1 speed (ahead) and -place (behind), as distances from the given values."""
    lead = np.where(np.isfinite(t.ahead), t.ahead - t.safe - 0.1 * t.v0, np.inf)
    tail = np.where(np.isfinite(t.behind), t.behind - t.safe - 0.1 * limits.v_max, np.inf)
    return lead, tail


def _chains(t: Trips, limits: Limits, rows: list[tuple], move: tuple[float, float, float, float], end_still: bool) -> Chains:
    """Programme in (v - v0, x - x0, a). rows: limits (row's coefficients, those of the row above, right side).

    move (p, q, r, s): v_t = v_{t-1} + p a_{t-1} + q a_t and x_t = x_{t-1} + v_{t-1} + r a_{t-1} + s a_t.
    """
    n = len(t.v0)
    p, q, r, s = move
    E = np.broadcast_to(np.array([[1.0, 0.0, -q], [0.0, 1.0, -s]]), (n, 2, 3))
    P = np.broadcast_to(np.array([[-1.0, 0.0, -p], [-1.0, -1.0, -r]]), (n, 2, 3))
    back_v, back_x = np.append(0.0, t.v0[:-1]), np.append(0.0, t.x0[:-1])
    e = np.stack([back_v - t.v0, back_x + back_v - t.x0], axis=1)
    lead, tail = _room(t, limits)
    rows = [
        *rows, ((1, 0, 0), None, limits.v_max - t.v0), ((-1, 0, 0), None, t.v0), ((0.1, 1, 0), None, lead), ((0, -1, 0), None, tail)
    ]
    G, H, h = np.zeros((n, len(rows), 3)), np.zeros((n, len(rows), 3)), np.empty((n, len(rows)))
    for i, (own, above, bound) in enumerate(rows):
        G[:, i] = own
        h[:, i] = bound
        if above is not None:
            H[:, i, 2] = above
            h[t.first, i] = np.inf
    fixed = np.zeros((n, 3), bool)
    fixed[:, 0] = fixed[:, 1] = t.lock
    if end_still:  # the first acceleration moves nothing and costs, the last is 0 by rule
        fixed[:, 2] = t.first | t.last
    Q = np.broadcast_to(2 * np.diag([limits.w_speed, limits.w_place, limits.w_accel]), (n, 3, 3))
    return Chains(t.first, Q, np.zeros((n, 3)), E, P, e, G, H, h, fixed, np.zeros((n, 3)))


def first_stage(t: Trips, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, x, a) by row and the reason by trip (None: solved)."""
    n = len(t.v0)
    most, step = np.full(n, limits.a_max), np.full(n, limits.max_step)
    rows = [((0, 0, 1), None, most), ((0, 0, -1), None, most), ((0, 0, 1), -1.0, step), ((0, 0, -1), 1.0, step)]
    reason = t.reasons(limits)
    z = np.zeros((n, 3))
    tried = np.repeat(reason == None, np.diff(np.append(t.starts, n)))  # noqa: E711
    if tried.any():
        chains = _chains(t, limits, rows, (0.0, 1.0, 0.0, 0.5), end_still=True).take(tried)
        z[tried], outcome, _ = solve(chains, limits.tolerance)
        reason[reason == None] = OUTCOMES[outcome]  # noqa: E711
    return np.maximum(t.v0 + z[:, 0], 0), t.x0 + z[:, 1], z[:, 2], reason


class Envelope:
    """jerk_min and jerk_max at ascending accelerations, linear between them."""

    def __init__(self, rows: np.ndarray, a_max: float):
        at, low, high = rows.T
        cut = np.unique(np.clip(np.concatenate([at, [-a_max, a_max]]), -a_max, a_max))
        self.at = cut[(cut >= at[0] - 1e-9) & (cut <= at[-1] + 1e-9)]
        self.low, self.high = np.interp(self.at, at, low), np.interp(self.at, at, high)
        self.pieces = len(self.at) - 1
        self._known: dict[tuple[int, int], np.ndarray] = {}

    def outside(self, a: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far jerks are outside, 0 inside."""
        return np.maximum(np.maximum(np.interp(a, self.at, self.low) - j, j - np.interp(a, self.at, self.high)), 0)

    def facets(self, i: int, k: int) -> np.ndarray:
        """Lines (slope, height) above jerk_max and below jerk_min from knot i to knot k: (2, FACETS, 2), repeated to fill."""
        if (i, k) not in self._known:
            x = self.at[i : k + 1]
            self._known[i, k] = np.stack([self._lines(x, self.high[i : k + 1]), -self._lines(x, -self.low[i : k + 1])])
        return self._known[i, k]

    @staticmethod
    def _lines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The widest FACETS lines of the least concave function above the points."""
        hull: list[int] = []
        for p in range(len(x)):
            while len(hull) > 1 and (y[p] - y[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]) >= (y[hull[-1]] - y[hull[-2]]) * (x[p] - x[hull[-2]]):
                hull.pop()
            hull.append(p)
        left, right = np.array(hull[:-1]), np.array(hull[1:])
        widest = np.argsort(x[left] - x[right], kind="stable")[:FACETS]
        slope = (y[right] - y[left])[widest] / (x[right] - x[left])[widest]
        lines = np.stack([slope, y[left[widest]] - slope * x[left[widest]]], axis=1)
        return np.concatenate([lines, np.repeat(lines[-1:], FACETS - len(lines), axis=0)])


def _relaxed(t: Trips, low: np.ndarray, high: np.ndarray, env: Envelope, limits: Limits):
    """Solution where row i's acceleration lies between knots low[i] and high[i], and jerks in the hull over that range."""
    n = len(t.v0)
    pairs, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
    lines = np.stack([env.facets(int(i), int(k)) for i, k in pairs])[which.ravel()]
    above = np.roll(lines, 1, axis=0)  # the envelope belongs to the row that the jerk starts from
    rows: list[tuple] = [
        ((0, 0, 1), None, np.where(t.last, limits.a_max, env.at[high])), ((0, 0, -1), None, np.where(t.last, limits.a_max, -env.at[low])),
        ((0, 0, 1), -1.0, np.full(n, limits.max_step)), ((0, 0, -1), 1.0, np.full(n, limits.max_step)),
    ]
    for f in range(FACETS):
        rows.append(((0, 0, 1), -(1 + above[:, 0, f, 0]), above[:, 0, f, 1]))
        rows.append(((0, 0, -1), 1 + above[:, 1, f, 0], -above[:, 1, f, 1]))
    return solve(_chains(t, limits, rows, (0.5, 0.5, 1 / 3, 1 / 6), end_still=False), limits.tolerance)


@dataclass
class _Search:
    """What is known of a trip: open nodes (bound, low, high), the best result and its cost, nodes used."""

    rows: slice
    open: list[tuple[float, np.ndarray, np.ndarray]]
    best: np.ndarray | None = None
    cost: float = np.inf
    used: int = 0
    outcome: int = INFEASIBLE

    def bound(self) -> float:
        return min([self.cost, *(b for b, _, _ in self.open)])

    def worth(self, limits: Limits) -> float:
        """Nodes that can't be better than this don't matter."""
        return self.cost - limits.mip_gap * abs(self.cost) if np.isfinite(self.cost) else np.inf

    def gap(self) -> float:
        return 0.0 if not np.isfinite(self.cost) else (self.cost - self.bound()) / max(abs(self.cost), 1e-9)


def second_stage(t: Trips, env: Envelope, limits: Limits):
    """(v, x, a) by row, the reason and the gap by trip: branch and bound, a node of each unfinished trip in every round."""
    n, ends = len(t.v0), np.append(t.starts, len(t.v0))
    reason, gap, z_all = t.reasons(limits), np.zeros(len(t.starts)), np.zeros((n, 3))
    searches = {}
    for k in np.flatnonzero(reason == None):  # noqa: E711
        size = ends[k + 1] - ends[k]
        searches[k] = _Search(slice(ends[k], ends[k + 1]), [(-np.inf, np.zeros(size, int), np.full(size, env.pieces))])
    unfinished = list(searches)
    while unfinished:
        nodes = []
        for k in unfinished:
            s = searches[k]
            s.open.sort(key=lambda node: -node[0])
            nodes.append((k, *s.open.pop()[1:], False))
        # each relaxation that is outside the envelope also tries the pieces that its accelerations lie in
        for k, low, high, z, outcome, cost in _solve_nodes(t, nodes, searches, env, limits):
            s, z0 = searches[k], z
            s.used += 1
            if outcome != SOLVED:
                s.outcome = max(s.outcome, outcome)
                continue
            off = _outside(z0, env)
            if off.max() <= 1e-5:
                if cost < s.cost:
                    s.best, s.cost = z, cost
                continue
            if cost >= s.worth(limits):
                continue
            piece = np.clip(np.searchsorted(env.at, z[:, 2], side="right") - 1, low, high - 1)
            nodes_here = (k, piece, piece + 1, True)
            (_, _, _, z1, fits, cost1), *_ = _solve_nodes(t, [nodes_here], searches, env, limits)
            s.used += 1
            if fits == SOLVED and cost1 < s.cost:
                s.best, s.cost = z1, cost1
            row = int(off.argmax())
            cut = int(np.clip(np.searchsorted(env.at, z[row, 2]), low[row] + 1, high[row] - 1))
            for a, b in ((low[row], cut), (cut, high[row])):
                one, two = low.copy(), high.copy()
                one[row], two[row] = a, b
                s.open.append((cost, one, two))
        unfinished = [k for k in unfinished if _goes_on(searches[k], limits)]
    for k, s in searches.items():
        gap[k] = s.gap()
        if s.best is not None:
            z_all[s.rows] = s.best
        elif s.open:
            reason[k] = "no solution in the nodes allowed"
        else:
            reason[k] = OUTCOMES[s.outcome]
    return np.maximum(t.v0 + z_all[:, 0], 0), t.x0 + z_all[:, 1], z_all[:, 2], reason, gap


def _goes_on(s: _Search, limits: Limits) -> bool:
    s.open = [node for node in s.open if node[0] < s.worth(limits)]
    return bool(s.open) and s.used < limits.nodes


def _outside(z: np.ndarray, env: Envelope) -> np.ndarray:
    """By row, how far the jerk that starts there is outside the envelope (0 for the last row)."""
    return np.append(env.outside(z[:-1, 2], np.diff(z[:, 2])), 0.0)


def _solve_nodes(t: Trips, nodes: list[tuple], searches: dict[int, _Search], env: Envelope, limits: Limits):
    """(trip, low, high, z, outcome, cost) of each node (trip, low, high, _), solved together."""
    rows = np.concatenate([np.arange(searches[k].rows.start, searches[k].rows.stop) for k, *_ in nodes])
    z, outcome, cost = _relaxed(t.take(rows), np.concatenate([x[1] for x in nodes]), np.concatenate([x[2] for x in nodes]), env, limits)
    at = 0
    for i, (k, low, high, _) in enumerate(nodes):
        yield k, low, high, z[at : at + len(low)], int(outcome[i]), float(cost[i])
        at += len(low)


def _one(v0, x0, ahead, behind, safe) -> Trips:
    v0 = np.asarray(v0, float)
    first = np.arange(len(v0)) == 0
    x0 = unit_places(v0, first) if x0 is None else np.asarray(x0, float)
    none = np.full(len(v0), np.nan)
    return Trips(first, v0, x0, none if ahead is None else ahead, none if behind is None else behind, safe)


def stage_one(v0, limits: Limits, ahead=None, behind=None, safe: float = 0.0, x0=None) -> np.ndarray | None:
    """Accelerations a_0..a_{n-1} of one trip, with v_t = v0_0 + a_0 + ... + a_t; None without a solution.

    ahead, behind: distances from the given place to the vehicle ahead and from the one behind, NaN where there is none.
    """
    _, _, a, reason = first_stage(_one(v0, x0, ahead, behind, safe), limits)
    return a if reason[0] is None else None


def stage_two(v0, env: np.ndarray, limits: Limits, ahead=None, behind=None, safe: float = 0.0, x0=None):
    """(v, a, gap) of one trip with jerks inside the envelope (rows accel, jerk_min, jerk_max); None without a solution."""
    v, _, a, reason, gap = second_stage(_one(v0, x0, ahead, behind, safe), Envelope(env, limits.a_max), limits)
    return (v, a, gap[0]) if reason[0] is None else None


def unit_places(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of rows a second apart, 0 at the first row of each trip."""
    gone = pd.Series(np.where(first, 0.0, (v + np.append(0.0, v[:-1])) / 2))
    return gone.groupby(np.cumsum(first)).cumsum().to_numpy()  # a sum over all would carry a trip's odd speeds into the next


_COLUMNS = {V: "double", A: "double", S: "double", J: "double", "reason": "string", "gap": "double"}


def _by_trip(rows: DataFrame, run_trips: Callable[[Trips], tuple], safe: float) -> DataFrame:
    """KEYS, T and _COLUMNS for every row: results of run_trips(trips) -> (v, x, a, reason, gap).

    Trips are dealt over the cluster and sorted there; a task solves whole trips of some TOGETHER rows at a time and
    holds these and the trip that goes on into its next batch, whatever the number of trips. Of rows of one time one counts.
    """

    def solved(frames: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(frames, ignore_index=True)
        vid, trip, time = (frame[c].to_numpy() for c in (*KEYS, T))
        other = (vid[1:] != vid[:-1]) | (trip[1:] != trip[:-1])
        once = np.append(True, other | (time[1:] != time[:-1]))
        first = np.append(True, other)[once]
        frame = frame[once].reset_index(drop=True)
        v0, x0, ahead, behind = (frame[c].to_numpy(float) for c in (V, S, AHEAD, BEHIND))
        trip_of, derived = np.cumsum(first) - 1, unit_places(v0, first)
        gaps = np.logical_or.reduceat(np.isnan(x0), np.flatnonzero(first))[trip_of]
        trips = Trips(first, v0, np.where(gaps, derived, x0), ahead, behind, safe)
        # memory is that of the trips solved together, however long the frame is
        number = (np.cumsum(np.diff(np.append(trips.starts, len(first)))) // together)[trip_of]
        at = [0, *np.flatnonzero(np.diff(number)) + 1, len(first)]
        parts = [run_trips(trips.take(slice(i, k))) for i, k in zip(at[:-1], at[1:], strict=True)]
        v, x, a, reason, gap = (np.concatenate(found) for found in zip(*parts, strict=True))
        good = np.array([r is None for r in reason])[trip_of]
        hold = lambda values: np.where(good, values, np.nan)
        jerk = np.append(np.diff(a), 0.0)
        return frame[[*KEYS, T]].assign(
            **{V: hold(v), A: hold(a), S: hold(x), J: hold(np.where(trips.last, 0.0, jerk)), "reason": reason[trip_of], "gap": hold(gap[trip_of])}
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        ready, n = [], 0
        for frame in frames:
            if not len(frame):
                continue
            vid, trip = frame[VID].to_numpy(), frame["trip_id"].to_numpy()
            if held and (held[-1][VID].iloc[-1], held[-1]["trip_id"].iloc[-1]) != (vid[0], trip[0]):
                ready, n, held = [*ready, *held], n + sum(map(len, held)), []
            cut = int(np.argmax((vid == vid[-1]) & (trip == trip[-1])))  # where the batch's last trip begins
            if cut:
                ready, n, held = [*ready, *held, frame.iloc[:cut]], n + sum(map(len, held)) + cut, []
            held.append(frame.iloc[cut:])
            if n >= together:
                yield solved(ready)
                ready, n = [], 0
        if ready or held:
            yield solved([*ready, *held])

    together = TOGETHER
    ship(rows.sparkSession)
    schema = f"{VID} string, trip_id long, {T} double, " + ", ".join(f"{c} {k}" for c, k in _COLUMNS.items())
    given = rows.select(F.col(VID).cast("string").alias(VID), F.col("trip_id").cast("long").alias("trip_id"), T, V, S, AHEAD, BEHIND)
    return given.repartition(*KEYS).sortWithinPartitions(*KEYS, T).mapInPandas(run, schema)


def _prepared(df: DataFrame) -> DataFrame:
    """df with a place (rows a second apart) if it has no odometer, and headways (none) if it has none."""
    if S not in df.columns:
        w = Window.partitionBy(*KEYS).orderBy(T)
        gone = F.coalesce((F.col(V) + F.lag(V).over(w)) / 2, F.lit(0.0))
        df = df.withColumn(S, F.sum(gone).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    none = F.lit(None).cast("double")
    if AHEAD not in df.columns or BEHIND not in df.columns:
        df = df.withColumns({AHEAD: none, BEHIND: none})
    return df


def refine_stage_one(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """df with speed, acceleration and odometer overwritten in the trips that have a solution, `solved` and `reason`.

    Where df has headways (`neighbors.neighbours`), trips keep room to the vehicles ahead and behind.
    """
    df = stored(df)  # read several times, and dear where the headways come from a join
    full = _prepared(df)
    safe = safe_distance(df).first()[0] if AHEAD in df.columns and BEHIND in df.columns else 0.0

    def run(t: Trips) -> tuple:
        v, x, a, reason = first_stage(t, limits)
        return v, x, a, reason, np.zeros(len(reason))

    found = _by_trip(moving_only(full.where(F.col(V).isNotNull()), tuple(KEYS)), run, safe)
    out = df if S in df.columns else df.join(full.select(*KEYS, T, S).dropDuplicates([*KEYS, T]), [*KEYS, T], "left").select(*df.columns, S)
    return _with_result(out, found, [V, A, S], [])


def refine_stage_two(df: DataFrame, bad: DataFrame, envelope: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """df with speed, acceleration, jerk and odometer overwritten in those of the bad trips that have a solution.

    Adds `solved`, `reason` and `gap` (null outside the bad trips). envelope: at most a few hundred rows (accel_d10,
    jerk_min, jerk_max), which go to every task.
    """
    env = np.array([[r.accel_d10 / 10, r.jerk_min, r.jerk_max] for r in envelope.orderBy("accel_d10").collect()])
    df = stored(df)
    full = _prepared(df)
    safe = safe_distance(df).first()[0] if AHEAD in df.columns and BEHIND in df.columns else 0.0

    def run(t: Trips) -> tuple:
        return second_stage(t, Envelope(env, limits.a_max), limits)

    rows = full.where(F.col(V).isNotNull()).join(bad.select(*KEYS), KEYS, "left_semi")
    out = df if S in df.columns else df.join(full.select(*KEYS, T, S).dropDuplicates([*KEYS, T]), [*KEYS, T], "left").select(*df.columns, S)
    return _with_result(out, _by_trip(rows, run, safe), [V, A, S, *([J] if J in df.columns else [])], ["gap"])


def _with_result(df: DataFrame, found: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """df with the found columns where they aren't null, and `solved`, `reason` (and others) of its trips' results."""
    side = found.select(*KEYS, T, *[F.col(c).alias(f"_{c}") for c in [*columns, *added, "reason"]], F.lit(True).alias("_tried"))
    both = df.drop("solved", "reason", *added).join(side, [*KEYS, T], "left")
    solved = F.coalesce(F.col("_tried") & F.col("_reason").isNull(), F.lit(False))
    untried = F.when(F.col(V).isNull(), "no speed").otherwise("not moving") if not added else F.lit(None)
    both = both.withColumns(
        {"solved": solved, "reason": F.when(F.col("_tried"), F.col("_reason")).otherwise(untried), **{c: F.col(f"_{c}") for c in added}}
    )
    both = both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return both.select(*[c for c in df.columns if c not in ("solved", "reason", *added)], "solved", "reason", *added)
