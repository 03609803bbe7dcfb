"""Convex quadratic programmes over chains of states, many chains at once, in time linear in their rows.

Every row has a state z_i of a few numbers; rows of a chain follow one another. The programme of a chain is

    minimise    sum z_i' Q_i z_i / 2 + q_i' z_i
    subject to  E_i z_i + P_i z_{i-1} = e_i        (rows after the chain's first)
                G_i z_i + H_i z_{i-1} <= h_i       (h_i infinite: no limit)

and some components of z are fixed. It is solved by an interior-point method (predictor and corrector steps, each chain
with its own step length). The linear systems are block-tridiagonal, with blocks of the state and its equations; odd rows
are eliminated, then every other of those that remain, and so on, which works on whole arrays for all chains together and
takes memory linear in the rows, so one chain of many thousands of rows is no harder than as many rows of short ones.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

SOLVED, INFEASIBLE, NO_CONVERGENCE = 0, 1, 2


@dataclass
class Chains:
    """Arrays with a row for each state. first: whether a chain begins there. fixed, value: components that are given."""

    first: np.ndarray  # (n,) bool
    Q: np.ndarray  # (n, k, k)
    q: np.ndarray  # (n, k)
    E: np.ndarray  # (n, m, k)
    P: np.ndarray  # (n, m, k)
    e: np.ndarray  # (n, m)
    G: np.ndarray  # (n, l, k)
    H: np.ndarray  # (n, l, k)
    h: np.ndarray  # (n, l)
    fixed: np.ndarray  # (n, k) bool
    value: np.ndarray  # (n, k)

    def take(self, rows: np.ndarray | slice) -> Chains:
        return Chains(*[getattr(self, f.name)[rows] for f in fields(self)])


def _apply(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", a, x)


def _back(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("nij,ni->nj", a, x)


def _above(x: np.ndarray) -> np.ndarray:
    """Each row's predecessor (zeros for the first)."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def _below(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    return out


class Tridiagonal:
    """Cyclic reduction of a symmetric block-tridiagonal matrix: blocks on the diagonal and left of it."""

    def __init__(self, diagonal: np.ndarray, left: np.ndarray):
        self.levels = []
        while len(diagonal) > 1:
            if len(diagonal) % 2:
                diagonal = np.concatenate([diagonal, np.eye(diagonal.shape[1])[None]])
                left = np.concatenate([left, np.zeros_like(left[:1])])
            inverse = np.linalg.inv(diagonal[1::2])
            low = left[1::2]  # an odd row's coupling to the even row above
            up = _below(left[::2])  # the coupling of the even row below it to it
            into = inverse @ low
            high = inverse @ up.transpose(0, 2, 1)
            self.levels.append((inverse, low, up, into, high))
            even, even_left = diagonal[::2] - low.transpose(0, 2, 1) @ into, -_above(up @ into)
            even = even - _above(up @ high)
            diagonal, left = even, even_left
        self.last = np.linalg.inv(diagonal)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        kept = []
        for inverse, _, _, into, high in self.levels:
            n = len(rhs)
            if n % 2:
                rhs = np.concatenate([rhs, np.zeros_like(rhs[:1])])
            odd = rhs[1::2]
            kept.append((n, odd))
            rhs = rhs[::2] - _back(into, odd) - _above(_back(high, odd))
        x = _apply(self.last, rhs)
        for (inverse, _, _, into, high), (n, odd) in zip(reversed(self.levels), reversed(kept), strict=True):
            out = np.empty((2 * len(x), x.shape[1]))
            out[::2] = x
            out[1::2] = _apply(inverse, odd) - _apply(into, x) - _apply(high, _below(x))
            x = out[:n]
        return x


def solve(given: Chains, tolerance: float = 1e-6, steps: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, outcome of each chain, objective of each chain). z of chains that aren't SOLVED means nothing.

    INFEASIBLE: the multipliers prove that no z keeps all limits. NO_CONVERGENCE: neither was found in so many steps,
    or in finite numbers.
    """
    starts = np.flatnonzero(given.first)
    n, k = given.q.shape
    z_all, outcome = np.zeros((n, k)), np.full(len(starts), NO_CONVERGENCE)
    c, numbers = _substituted(given), np.arange(len(starts))
    rows = np.arange(n)
    state = _start(c)
    for step in range(steps):
        z, nu, lam, s = state
        begin = np.flatnonzero(c.first)
        measure = _residuals(c, z, nu, lam, s)
        worst = lambda x: np.maximum.reduceat(np.abs(x).max(axis=1, initial=0), begin)
        rd, re, rp = (worst(x) for x in measure)
        active = np.isfinite(c.h)
        pairs = np.maximum(np.add.reduceat(active.sum(axis=1), begin), 1)
        mu = np.add.reduceat(np.where(active, s * lam, 0).sum(axis=1), begin) / pairs
        scale = 1 + worst(c.q)
        good = (rd <= tolerance * scale) & (re <= tolerance) & (rp <= tolerance) & (mu <= tolerance * 1e-2 * scale)
        bad = ~good & _separates(c, nu, lam, begin, worst)
        done = good | bad | (step == steps - 1)
        if done.any():
            local = np.cumsum(c.first) - 1
            solved_rows = good[local]
            z_all[rows[solved_rows]] = z[solved_rows]
            outcome[numbers[good]], outcome[numbers[bad]] = SOLVED, INFEASIBLE
            stay = ~done[local]
            if not stay.any():
                break
            c, rows, numbers = c.take(stay), rows[stay], numbers[~done]
            z, nu, lam, s = (x[stay] for x in state)
            measure, mu, begin = [x[stay] for x in measure], mu[~done], np.flatnonzero(c.first)
        state, broken = _stepped(c, [z, nu, lam, s], measure, mu)
        if broken.any():
            if broken.all():
                break
            stay = ~broken[np.cumsum(c.first) - 1]
            c, rows, numbers, state = c.take(stay), rows[stay], numbers[~broken], [x[stay] for x in state]
    z_all = np.where(given.fixed, given.value, z_all)
    cost = np.add.reduceat((z_all * (0.5 * _apply(given.Q, z_all) + given.q)).sum(axis=1), starts)
    return z_all, outcome, cost


def _substituted(g: Chains) -> Chains:
    """The programme in the components that aren't fixed: constants move to the right side, limits that are none to 1."""
    inner = ~g.first
    E, P = g.E * inner[:, None, None], g.P * inner[:, None, None]
    H = g.H * inner[:, None, None]
    value = np.where(g.fixed, g.value, 0.0)
    above = _above(value)
    e = np.where(inner[:, None], g.e - _apply(E, value) - _apply(P, above), 0.0)
    h = g.h - _apply(g.G, value) - _apply(H, above)
    q = np.where(g.fixed, 0.0, g.q + _apply(g.Q, value))
    free = ~g.fixed
    free_above = _above(free.astype(float)) > 0
    Q = g.Q * free[:, :, None] * free[:, None, :]
    E, G = E * free[:, None, :], g.G * free[:, None, :]
    P, H = P * free_above[:, None, :], H * free_above[:, None, :]
    # limits on fixed components alone hold or don't: the solver would only see a constant
    empty = (np.abs(G).max(axis=2) == 0) & (np.abs(H).max(axis=2) == 0)
    h = np.where(empty & (h >= -1e-6), np.inf, h)
    return Chains(g.first, Q, q, E, P, e, G, H, h, g.fixed, value)


def _start(c: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    z = np.zeros_like(c.q)
    active = np.isfinite(c.h)
    s = np.where(active, np.maximum(np.where(active, c.h, 1.0), 1.0), 1.0)
    return z, np.zeros_like(c.e), np.where(active, 1.0, 0.0), s


def _residuals(c: Chains, z, nu, lam, s) -> list[np.ndarray]:
    dual = _apply(c.Q, z) + c.q + _back(c.E, nu) + _below(_back(c.P, nu)) + _back(c.G, lam) + _below(_back(c.H, lam))
    above = _above(z)
    equal = _apply(c.E, z) + _apply(c.P, above) - c.e
    active = np.isfinite(c.h)
    limit = np.where(active, _apply(c.G, z) + _apply(c.H, above) + s - np.where(active, c.h, 0.0), 0.0)
    return [dual, equal, limit]


def _separates(c: Chains, nu, lam, begin, worst) -> np.ndarray:
    """Whether the multipliers prove that no z keeps all limits: they cancel on the left side, and are negative on the right."""
    size = np.maximum(worst(nu), worst(lam))
    left = _back(c.E, nu) + _below(_back(c.P, nu)) + _back(c.G, lam) + _below(_back(c.H, lam))
    finite = np.isfinite(c.h)
    right = np.add.reduceat((c.e * nu).sum(axis=1) + np.where(finite, np.where(finite, c.h, 0) * lam, 0).sum(axis=1), begin)
    size = np.maximum(size, 1e-300)
    return (size > 1e3) & (worst(left) / size <= 1e-7) & (right / size < -1e-5)


def _stepped(c: Chains, state: list, measure: list, mu: np.ndarray) -> tuple[list, np.ndarray]:
    """_step of each chain, and the chains for which that has no finite numbers (their multipliers overflow).

    One such chain spoils all chains of a system (0 times infinity is no number, and a singular block stops the whole
    elimination), so these are halved until it is alone.
    """
    begin = np.flatnonzero(c.first)
    try:
        with np.errstate(all="ignore"):
            new = _step(c, *state, measure, mu, begin)
        if all(np.isfinite(x).all() for x in new):
            return list(new), np.zeros(len(begin), bool)
    except np.linalg.LinAlgError:
        pass
    if len(begin) == 1:
        return state, np.ones(1, bool)
    half = len(begin) // 2
    parts = [(slice(0, begin[half]), slice(0, half)), (slice(begin[half], None), slice(half, None))]
    found = [_stepped(c.take(at), [x[at] for x in state], [x[at] for x in measure], mu[of]) for at, of in parts]
    return [np.concatenate(x) for x in zip(*[f[0] for f in found], strict=True)], np.concatenate([f[1] for f in found])


def _step(c: Chains, z, nu, lam, s, measure, mu, begin, reg: float = 1e-8):
    rd, re, rp = measure
    active = np.isfinite(c.h)
    w = np.where(active, lam / s, 0.0)
    k, m = c.q.shape[1], c.e.shape[1]
    gw, hw = c.G * w[:, :, None], c.H * w[:, :, None]
    n = len(c.q)
    diagonal, left = np.zeros((n, k + m, k + m)), np.zeros((n, k + m, k + m))
    diagonal[:, :k, :k] = c.Q + c.G.transpose(0, 2, 1) @ gw + _below(c.H.transpose(0, 2, 1) @ hw) + reg * np.eye(k)
    diagonal[:, :k, k:], diagonal[:, k:, :k] = c.E.transpose(0, 2, 1), c.E
    diagonal[:, k:, k:] = -reg * np.eye(m)
    left[:, :k, :k] = c.G.transpose(0, 2, 1) @ hw
    left[:, k:, :k] = c.P
    system = Tridiagonal(diagonal, left)
    local = np.cumsum(c.first) - 1

    def direction(rc):
        t = np.where(active, (lam * rp - rc) / s, 0.0)
        rhs = np.concatenate([-rd - _back(c.G, t) - _below(_back(c.H, t)), -re], axis=1)
        d = system.solve(rhs)
        # what the regularisation and rounding left over
        again = rhs - _multiply(diagonal, left, d)
        again[:, :k] += reg * d[:, :k]
        again[:, k:] -= reg * d[:, k:]
        d = d + system.solve(again)
        dz, dnu = d[:, :k], d[:, k:]
        moved = _apply(c.G, dz) + _apply(c.H, _above(dz))
        ds = np.where(active, -rp - moved, 0.0)
        dlam = np.where(active, (-rc - lam * ds) / s, 0.0)
        return dz, dnu, dlam, ds

    def longest(x, dx):
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(active & (dx < 0), -x / dx, np.inf)
        return np.minimum(np.minimum.reduceat(room.min(axis=1, initial=np.inf), begin), 1.0)

    dz, dnu, dlam, ds = direction(s * lam)
    ap, ad = longest(s, ds), longest(lam, dlam)
    pairs = np.maximum(np.add.reduceat(active.sum(axis=1), begin), 1)
    ahead = (s + ap[local][:, None] * ds) * (lam + ad[local][:, None] * dlam)
    mu_ahead = np.add.reduceat(np.where(active, ahead, 0).sum(axis=1), begin) / pairs
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = np.where(mu > 0, (mu_ahead / mu) ** 3, 0.0)
    target = (sigma * mu)[local][:, None]
    dz, dnu, dlam, ds = direction(np.where(active, s * lam + ds * dlam - target, 0.0))
    ap = np.minimum(0.995 * longest(s, ds), 1.0)[local][:, None]
    ad = np.minimum(0.995 * longest(lam, dlam), 1.0)[local][:, None]
    return z + ap * dz, nu + ad * dnu, np.where(active, lam + ad * dlam, 0.0), np.where(active, s + ap * ds, 1.0)


def _multiply(diagonal: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _apply(diagonal, x) + _apply(left, _above(x)) + _below(_back(left, x))
