"""Minimisers of functions of a few variables, for one instance, or for stacks of them (see `lockstep.both`). Each returns the
point it reached and diagnostics: rounds, value, converged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fathom.functions.local import gradient as _gradient
from fathom.functions.lockstep import Rows, alone, both, gradient, size, until

Vector = np.ndarray
Function = Callable[[Vector], float]
Slope = Callable[[Vector], Vector]


def _slope(f: Function, slope: Slope | None) -> Slope:
    return slope or (lambda x, rows: gradient(f, x, rows))


def _told(f: Function, found: tuple[Vector, dict], rows: Rows) -> tuple[Vector, dict]:
    x, told = found
    return x, {"rounds": told["rounds"], "value": f(x, rows), "converged": told["converged"]}


def _dot(a: Vector, b: Vector) -> Vector:
    return (a * b).sum(0)


def _search(f: Function, x: Vector, p: Vector, g: Vector, rows: Rows) -> Vector:
    """Steps along p that lower f enough, or nothing."""
    step, fx, fall = np.ones(x.shape[1]), f(x, rows), _dot(g, p)
    at = np.arange(x.shape[1])
    while len(at):
        rows = rows if len(at) == len(rows) else rows.take(far)  # noqa: F821
        far = f(x[:, at] + step[at] * p[:, at], rows) > fx[at] + 1e-4 * step[at] * fall[at]
        step[at[far]] /= 2
        spent = step[at] < 1e-18
        step[at[spent]] = 0.0
        far &= ~spent
        at = at[far]
    return step


@both
def gradient_descent(f: Function, x: Vector, slope: Slope | None = None, rounds: int = 10_000, tol: float = 1e-8, *, rows: Rows) -> tuple[Vector, dict]:
    slope = _slope(f, slope)

    def flat(s, r):
        s["g"] = slope(s["x"], r)
        done = size(s["g"]) < tol
        return done, done

    def walk(s, r):
        step = _search(f, s["x"], -s["g"], s["g"], r)
        s["x"] = s["x"] - step * s["g"]
        return step == 0, size(s["g"]) < 1e3 * tol

    return _told(f, until(rounds, {"x": x, "g": np.zeros_like(x)}, rows, flat, walk), rows)


@both
def conjugate_gradients(f: Function, x: Vector, slope: Slope | None = None, rounds: int = 5000, tol: float = 1e-8, *, rows: Rows) -> tuple[Vector, dict]:
    """Polak and Ribiere's directions, begun anew when they do not fall."""
    slope = _slope(f, slope)
    g = slope(x, rows)

    def flat(s, r):
        done = size(s["g"]) < tol
        return done, done

    def walk(s, r):
        x, g = s["x"], s["g"]
        p = np.where(_dot(g, s["p"]) >= 0, -g, s["p"])
        step = _search(f, x, p, g, r)
        stuck, steepest = step == 0, (p == -g).all(0)
        s["x"] = x + step * p
        new = slope(s["x"], r)
        s["p"] = np.where(stuck, -g, -new + np.maximum(0.0, _dot(new, new - g) / _dot(g, g)) * p)
        s["g"] = np.where(stuck, g, new)
        return stuck & steepest, size(g) < 1e3 * tol

    return _told(f, until(rounds, {"x": x, "g": g, "p": -g}, rows, flat, walk), rows)


@both
def lbfgs(f: Function, x: Vector, slope: Slope | None = None, memory: int = 8, rounds: int = 1000, tol: float = 1e-8, *, rows: Rows) -> tuple[Vector, dict]:
    slope = _slope(f, slope)
    none = np.zeros((memory, *x.shape))

    def flat(s, r):
        done = size(s["g"]) < tol
        return done, done

    def walk(s, r):
        x, g, ds, dy = s["x"], s["g"], s["ds"], s["dy"]
        # the newest pair is last; a place without a pair holds zeros and changes nothing
        ys = (ds * dy).sum(1)
        held = ys != 0
        over = 1 / np.where(held, ys, 1.0)
        q, weights = g.copy(), []
        for k in reversed(range(memory)):
            a = np.where(held[k], (ds[k] * q).sum(0) * over[k], 0.0)
            weights.append(a)
            q = q - a * dy[k]
        q = q * np.where(held[-1], ys[-1] / np.where(held[-1], _dot(dy[-1], dy[-1]), 1.0), 1.0)
        for k, a in zip(range(memory), reversed(weights), strict=True):
            q = q + ds[k] * np.where(held[k], a - _dot(dy[k], q) * over[k], 0.0)
        step = _search(f, x, -q, g, r)
        new = x - step * q
        h = slope(new, r)
        bent = _dot(new - x, h - g) > 1e-14
        s["ds"] = np.where(bent, np.concatenate([ds[1:], (new - x)[None]]), ds)
        s["dy"] = np.where(bent, np.concatenate([dy[1:], (h - g)[None]]), dy)
        s["x"], s["g"] = new, h
        return step == 0, size(g) < 1e3 * tol

    return _told(f, until(rounds, {"x": x, "g": slope(x, rows), "ds": none, "dy": none}, rows, flat, walk), rows)


def scaled_descent(f: Function, x: Vector, slope: Slope | None = None, decay: float | None = None, rate: float = 0.1, rounds: int = 5000) -> tuple[Vector, dict]:
    """Steps over the root of gathered squared slopes: all of them (decay None), or a fading mean."""
    x, slope, s = np.asarray(x, float), slope or (lambda x: _gradient(f, x)), 0.0
    for k in range(rounds):
        g = slope(x)
        s = s + g * g if decay is None else decay * s + (1 - decay) * g * g
        x = x - (rate if decay is None else rate / (1 + k) ** 0.5) * g / (np.sqrt(s) + 1e-12)
    return x, {"rounds": rounds, "value": float(f(x)), "converged": bool(np.linalg.norm(slope(x)) < 1e-2)}


@both
def projected_gradient(f: Function, x: Vector, project: Callable[[Vector], Vector], slope: Slope | None = None, rounds: int = 5000, tol: float = 1e-9, *, rows: Rows) -> tuple[Vector, dict]:
    """Within a convex set that project maps onto."""
    slope = _slope(f, slope)

    def walk(s, r):
        x, step = s["x"], s["step"]
        g, fx, new = slope(x, r), f(x, r), np.empty_like(x)
        at, left = np.arange(x.shape[1]), r
        while len(at):
            h = step[at]
            y = project(x[:, at] - h * g[:, at], left)
            d = y - x[:, at]
            new[:, at] = y
            far = ~((f(y, left) <= fx[at] + _dot(g[:, at], d) + _dot(d, d) / (2 * h) + 1e-15) | (h < 1e-15))
            step[at[far]] /= 2
            at, left = at[far], left.take(far)
        short = size(new - x) <= tol * np.maximum(1.0, size(x))
        s["x"], s["step"] = new, step * 1.5
        return short, short

    return _told(f, until(rounds, {"x": project(x, rows), "step": np.ones(x.shape[1])}, rows, walk), rows)


@both
def augmented_lagrangian(f: Function, x: Vector, equal: list[Function], rounds: int = 50, tol: float = 1e-7, *, rows: Rows) -> tuple[Vector, dict]:
    """Under equations h(x) = 0: multipliers and a growing penalty around a quasi-Newton search."""

    def whole(v, r):
        out = f(v, r)
        for a, h in zip(r._multipliers, equal, strict=True):
            y = h(v, r)
            out = out + a * y + r._penalty / 2 * y**2
        return out

    def walk(s, r):
        m, rho = s["m"], s["rho"]
        s["x"], _ = lbfgs(whole, s["x"], rounds=300, tol=1e-7, rows=r.plus(_multipliers=m, _penalty=rho))
        off = np.array([h(s["x"], r) for h in equal])
        s["m"], far = m + rho * off, np.abs(off).max(0)
        s["rho"], s["worst"] = np.where(far > s["worst"] / 4, rho * 4, rho), far
        return far < tol, far < tol

    n = x.shape[1]
    x, told = _told(f, until(rounds, {"x": x, "m": np.zeros((len(equal), n)), "rho": np.full(n, 10.0), "worst": np.full(n, np.inf)}, rows, walk), rows)
    return x, told | {"rounds": np.where(told["converged"], told["rounds"] + 1, told["rounds"])}


@both
def trust_region(f: Function, x: Vector, slope: Slope | None = None, rounds: int = 500, tol: float = 1e-7, *, rows: Rows) -> tuple[Vector, dict]:
    """Conjugate gradients on the quadratic model within a radius that follows how well the model does."""
    slope = _slope(f, slope)

    def flat(s, r):
        s["g"] = slope(s["x"], r)
        done = size(s["g"]) < tol
        return done, done

    def inside(x, g, radius, r):
        """The step within the radius, and the bend of f along it."""
        h = 1e-5 * np.maximum(1.0, size(x))
        curved = lambda v: (slope(x + h * v, r) - slope(x - h * v, r)) / (2 * h)
        p, left, d, on = np.zeros_like(x), -g, -g, np.ones(x.shape[1], bool)
        for _ in range(2 * len(x)):
            n = np.where(on, size(d), 1.0)
            b = curved(d / n) * n
            bend, rr = _dot(d, b), _dot(left, left)
            step = np.where(bend > 0, rr / np.where(bend > 0, bend, 1.0), np.inf)
            ahead = p + np.where(np.isfinite(step), step, 0.0) * d
            edge = on & ((bend <= 0) | (size(ahead) >= radius))
            u, v, w = _dot(d, d), 2 * _dot(p, d), _dot(p, p) - radius * radius
            out = p + (-v + np.sqrt(np.maximum(v * v - 4 * u * w, 0.0))) / (2 * np.where(edge, u, 1.0)) * d
            on = on & ~edge
            p = np.where(edge, out, np.where(on, ahead, p))
            new = left - np.where(on, step, 0.0) * b
            on = on & (size(new) >= 1e-10 * size(g))
            if not on.any():
                break
            d = np.where(on, new + _dot(new, new) / np.where(rr > 0, rr, 1.0) * d, d)
            left = np.where(on, new, left)
        n = size(p)
        return p, _dot(p, curved(p / np.where(n > 0, n, 1.0))) * n

    def walk(s, r):
        x, g, radius = s["x"], s["g"], s["radius"]
        p, bend = inside(x, g, radius, r)
        n = size(p)
        foretold = -(_dot(g, p) + bend / 2)
        lost = foretold <= 0
        ratio = (f(x, r) - f(x + p, r)) / np.where(lost, 1.0, foretold)
        s["x"] = np.where(~lost & (ratio > 1e-4), x + p, x)
        s["radius"] = np.where(ratio < 0.25, radius / 4, np.where((ratio > 0.75) & (n > 0.9 * radius), np.minimum(2 * radius, 1e6), radius))
        return lost | (s["radius"] < 1e-14), lost & (size(g) < 1e3 * tol)

    return _told(f, until(rounds, {"x": x, "g": np.zeros_like(x), "radius": np.ones(x.shape[1])}, rows, flat, walk), rows)


@both
def annealing(f: Function, x: Vector, width: float = 1.0, rounds: int = 20_000, seed: int = 0, *, rows: Rows) -> tuple[Vector, dict]:
    """Random steps, uphill ones ever more seldom; then a local search from the best point. Instances share the draws of a
    round, so that none depends on which others are in its stack."""
    g = np.random.default_rng(seed)
    fx = f(x, rows)
    best, at = fx.copy(), x.copy()
    for k in range(rounds):
        heat = (1 - k / rounds) ** 3 + 1e-9
        y = x + width * heat**0.5 * g.normal(size=(len(x), 1))
        fy = f(y, rows)
        taken = g.random() < np.exp(np.minimum(-(fy - fx) / heat, 0.0))
        x, fx = np.where(taken, y, x), np.where(taken, fy, fx)
        better = fx < best
        best, at = np.where(better, fx, best), np.where(better, x, at)
    x, told = lbfgs(f, at, rounds=200, rows=rows)
    n = x.shape[1]
    return x, {"rounds": np.full(n, rounds), "value": told["value"], "converged": np.ones(n, bool)}


def swarm(f: Function, low: Vector, high: Vector, people: int = 30, rounds: int = 300, seed: int = 0, rows: Rows | None = None) -> tuple[Vector, dict]:
    """Points drawn to their own best and to the best of all; instances of a stack share starts and draws."""
    if rows is None:
        x, told = swarm(alone(f), low, high, people, rounds, seed, Rows(1))
        return x[:, 0], {k: v[0].item() for k, v in told.items()}
    g = np.random.default_rng(seed)
    low, high = np.asarray(low, float)[:, None, None], np.asarray(high, float)[:, None, None]
    n, k = len(low), len(rows)
    all_rows = rows.take(np.tile(np.arange(k), people))
    value = lambda x: f(x.reshape(n, people * k), all_rows).reshape(people, k)
    draws = lambda: g.random((people, n)).T[:, :, None]
    x = np.broadcast_to(low + draws() * (high - low), (n, people, k))
    v, own, values = np.zeros((n, people, k)), x, value(x)
    best = lambda: np.take_along_axis(own, values.argmin(0)[None, None, :], 1)
    for _ in range(rounds):
        v = 0.72 * v + 1.49 * draws() * (own - x) + 1.49 * draws() * (best() - x)
        x = np.clip(x + v, low, high)
        now = value(x)
        own, values = np.where(now < values, x, own), np.minimum(values, now)
    x = best()[:, 0]
    return x, {"rounds": np.full(k, rounds), "value": f(x, rows), "converged": np.ptp(own, axis=1).max(0) < 1e-3 * (high - low).max()}
