"""Local numerical kernels over small arrays, and `each`, which runs one instance a row over a DataFrame.

Inputs are a few numbers or one small matrix; scale comes from many instances, which Spark spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathom.functions.lockstep import Rows, both, jacobian, solve, until
from fathom.session import spread

Vector = np.ndarray
Field = Callable[[float, Vector], Vector]


def each(df: DataFrame, id: str, f: Callable[[object], list[float]], out: str = "y") -> DataFrame:
    """(id, out array<double>): f of every row, in Arrow batches, rows spread over all cores."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({id: pdf[id], out: [[float(v) for v in f(r)] for r in pdf.itertuples(index=False)]})

    return spread(df, id).mapInPandas(run, f"`{id}` {kind}, `{out}` array<double>")


# ordinary differential equations


def rk45(f: Field, y: Vector, t: float, end: float, tol: float = 1e-8, most: int = 100_000, event: Callable[[float, Vector], float] | None = None) -> tuple[float, Vector, dict]:
    """Adaptive steps by the difference of one step and two half steps of the classical method, extrapolated.

    With `event`, stops where it changes sign, found by halving the last step. Returns time, state and diagnostics. Without it
    states may be stacks, instances last, each with its own steps; `end` may then be an array.
    """
    y, h, steps = np.asarray(y, float), (end - t) / 100, 0
    t = t + 0.0 * h

    def step(t, y, h):
        k1 = f(t, y)
        k2 = f(t + h / 2, y + h / 2 * k1)
        k3 = f(t + h / 2, y + h / 2 * k2)
        k4 = f(t + h, y + h * k3)
        return y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)

    def double(t, y, h):
        full = step(t, y, h)
        half = step(t + h / 2, step(t, y, h / 2), h / 2)
        return half + (half - full) / 15, np.max(np.abs(half - full) / (1 + np.abs(half)), axis=0) / 15

    sign = event(t, y) if event else 0.0
    while np.any(going := (end - t) * h > 0) and steps < most:
        steps += 1
        h = np.where(h > 0, np.minimum(h, end - t), np.maximum(h, end - t))[()]
        new, err = double(t, y, h)
        taken = going & ((err <= tol) | (np.abs(h) < 1e-14))
        if np.any(taken):
            if event and sign * event(t + h, new) < 0:
                lo, hi = 0.0, h
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sign * event(t + mid, double(t, y, mid)[0]) > 0 else (lo, mid)
                return t + hi, double(t, y, hi)[0], {"steps": steps, "event": True}
            last = np.abs(end - t - h) < 1e-14 * np.maximum(1, np.abs(end))
            t, y = np.where(taken, np.where(last, end, t + h), t)[()], np.where(taken, new, y)
            sign = event(t, y) if event else 0.0
        h = h * np.minimum(4.0, np.maximum(0.1, 0.9 * (tol / np.maximum(err, 1e-300)) ** 0.2))
    return t, y, {"steps": steps, "event": False}


def _newton(g: Callable[[Vector], Vector], x: Vector, rounds: int = 50, tol: float = 1e-12) -> Vector:
    """A root of g beside x; of a stack each instance stops by itself."""
    going = np.ones(x.shape[1:], bool)
    for _ in range(rounds):
        r = g(x)
        step = solve(jacobian(g, x, r), r)
        x = np.where(going, x - step, x)
        going = going & (np.abs(step).max(0) >= tol * np.maximum(1.0, np.abs(x).max(0)))
        if not going.any():
            break
    return x


def implicit(f: Field, y: Vector, t: float, end: float, steps: int, method: str = "trapezoid") -> Vector:
    """Stiff systems by "euler", "trapezoid" or "bdf2", a Newton solve a step. States may be stacks, instances last."""
    h, y, before = (end - t) / steps, np.asarray(y, float), None
    for k in range(steps):
        s, now = t + (k + 1) * h, y
        if method == "bdf2" and before is not None:
            last = before
            y = _newton(lambda z, s=s, now=now, last=last: z - (4 * now - last + 2 * h * f(s, z)) / 3, now)
        elif method == "euler":
            y = _newton(lambda z, s=s, now=now: z - now - h * f(s, z), now)
        else:
            y = _newton(lambda z, s=s, now=now: z - now - h / 2 * (f(s - h, now) + f(s, z)), now)
        before = now
    return y


def verlet(force: Callable[[Vector], Vector], x: Vector, v: Vector, h: float, steps: int) -> tuple[Vector, Vector]:
    """Positions and velocities under an acceleration that depends on position; keeps energy bounded."""
    x, v = np.asarray(x, float), np.asarray(v, float)
    a = force(x)
    for _ in range(steps):
        v = v + h / 2 * a
        x = x + h * v
        a = force(x)
        v = v + h / 2 * a
    return x, v


# partial differential equations on grids with fixed ends


def tridiagonal(low: Vector, mid: Vector, up: Vector, right: Vector) -> Vector:
    """Elimination without pivots; low[0] and up[-1] are not read."""
    n = len(mid)
    c, d = np.array(up, float), np.array(right, float)
    c[0], d[0] = up[0] / mid[0], d[0] / mid[0]
    for k in range(1, n):
        m = mid[k] - low[k] * c[k - 1]
        c[k] = up[k] / m
        d[k] = (d[k] - low[k] * d[k - 1]) / m
    for k in range(n - 2, -1, -1):
        d[k] -= c[k] * d[k + 1]
    return d


def reaction_diffusion(u: Vector, dx: float, dt: float, steps: int, diffusion: float, reaction: Callable[[Vector], Vector] | None = None) -> Vector:
    """u_t = D u_xx + r(u), end values held: implicit (trapezoid) diffusion, explicit reaction; stable for any step of diffusion."""
    u = np.array(u, float)
    r, n = diffusion * dt / (2 * dx * dx), len(u)
    low, mid, up = np.full(n, -r), np.full(n, 1 + 2 * r), np.full(n, -r)
    mid[0] = mid[-1] = 1.0
    up[0] = low[-1] = 0.0
    for _ in range(steps):
        right = u.copy()
        right[1:-1] += r * (u[2:] - 2 * u[1:-1] + u[:-2])
        if reaction:
            right[1:-1] += dt * reaction(u[1:-1])
        u = tridiagonal(low, mid, up, right)
    return u


def wave(u: Vector, velocity: Vector, dx: float, dt: float, steps: int, speed: float) -> Vector:
    """u_tt = c^2 u_xx with end values held, central differences; needs c dt <= dx."""
    if abs(speed) * dt > dx * (1 + 1e-12):
        raise ValueError("unstable: speed * dt exceeds dx")
    r = (speed * dt / dx) ** 2
    bend = lambda u: np.concatenate([[0], u[2:] - 2 * u[1:-1] + u[:-2], [0]])
    last = np.array(u, float)
    inner = np.concatenate([[0], np.ones(len(u) - 2), [0]])
    now = last + dt * np.asarray(velocity, float) * inner + r / 2 * bend(last)
    for _ in range(steps - 1):
        last, now = now, 2 * now - last + r * bend(now)
    return now


def conservation(u: Vector, dx: float, dt: float, steps: int, flux: Callable[[Vector], Vector], speed: Callable[[Vector], Vector], viscosity: float = 0.0) -> Vector:
    """u_t + flux(u)_x = viscosity u_xx on a ring, local Lax-Friedrichs fluxes: advection and Burgers' equation among others."""
    u = np.array(u, float)
    for _ in range(steps):
        r = np.roll(u, -1)
        a = np.maximum(np.abs(speed(u)), np.abs(speed(r)))
        f = (flux(u) + flux(r)) / 2 - a / 2 * (r - u)
        u = u - dt / dx * (f - np.roll(f, 1)) + viscosity * dt / dx**2 * (r - 2 * u + np.roll(u, 1))
    return u


def poisson_2d(source: np.ndarray, edge: np.ndarray, h: float) -> np.ndarray:
    """u_xx + u_yy = source inside, `edge` on the border: solved exactly in the sine basis, without relaxation rounds."""
    b = (h * h * np.asarray(source, float))[1:-1, 1:-1].copy()
    e = np.asarray(edge, float)
    b[0] -= e[0, 1:-1]
    b[-1] -= e[-1, 1:-1]
    b[:, 0] -= e[1:-1, 0]
    b[:, -1] -= e[1:-1, -1]

    def basis(n):
        k = np.arange(1, n + 1)
        return np.sqrt(2 / (n + 1)) * np.sin(np.pi * np.outer(k, k) / (n + 1)), 2 * np.cos(np.pi * k / (n + 1)) - 2

    (s, x), (r, y) = basis(b.shape[0]), basis(b.shape[1])
    out = e.copy()
    out[1:-1, 1:-1] = s @ ((s @ b @ r) / (x[:, None] + y[None, :])) @ r
    return out


# optimisation


@both
def nelder_mead(f: Callable[[Vector], float], x: Vector, size: float = 0.5, rounds: int = 5000, tol: float = 1e-12, *, rows: Rows) -> tuple[Vector, dict]:
    """A simplex that falls towards a minimum, also for stacks (see `lockstep.both`)."""
    n, k = x.shape
    p = np.stack([x, *(x + size * e[:, None] for e in np.eye(n))])

    def some(f, x, rows, which, otherwise):
        """f of the instances in which, else `otherwise`."""
        out = np.broadcast_to(otherwise, x.shape[1:]).copy()
        if which.any():
            out[which] = f(x[:, which], rows.take(which))
        return out

    def order(s, r):
        at = np.argsort(s["v"], axis=0, kind="stable")
        s["v"], s["p"] = np.take_along_axis(s["v"], at, 0), np.take_along_axis(s["p"], at[:, None], 0)
        p, v = s["p"], s["v"]
        s["x"] = p[0]
        done = (np.abs(v[-1] - v[0]) <= tol * (1 + np.abs(v[0]))) & (np.abs(p - p[0]).max((0, 1)) < 1e-8)
        return done, done

    def walk(s, r):
        p, v = s["p"].copy(), s["v"].copy()
        mid = p[:-1].mean(0)
        away = 2 * mid - p[-1]
        fr = f(away, r)
        first = fr < v[0]
        good = ~first & (fr < v[-2])
        inner = ~first & ~good
        e, c = 3 * mid - 2 * p[-1], (mid + np.where(fr < v[-1], away, p[-1])) / 2
        fe, fc = some(f, e, r, first, np.inf), some(f, c, r, inner, np.inf)
        further, nearer = first & (fe < fr), inner & (fc < np.minimum(fr, v[-1]))
        shrunk = inner & ~nearer
        p[-1] = np.where(further, e, np.where(first | good, away, np.where(nearer, c, p[-1])))
        v[-1] = np.where(further, fe, np.where(first | good, fr, np.where(nearer, fc, v[-1])))
        for i in range(1, n + 1):
            p[i] = np.where(shrunk, (p[i] + p[0]) / 2, p[i])
            v[i] = some(f, p[i], r, shrunk, v[i])
        s["p"], s["v"] = p, v
        none = np.zeros(len(fr), bool)
        return none, none

    x, told = until(rounds, {"x": x, "p": p, "v": np.stack([f(q, rows) for q in p])}, rows, order, walk)
    return x, {"rounds": told["rounds"], "value": f(x, rows), "converged": told["converged"]}


def differential_evolution(f: Callable[[Vector], float], low: Vector, high: Vector, rounds: int = 300, people: int = 40, seed: int = 0) -> tuple[Vector, float]:
    """Global search in a box: each point is tried against a mix of three others."""
    g = np.random.default_rng(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = low + g.random((people, len(low))) * (high - low)
    v = np.array([f(p) for p in x])
    for _ in range(rounds):
        for k in range(people):
            a, b, c = x[g.choice(people, 3, replace=False)]
            take = g.random(len(low)) < 0.9
            take[g.integers(len(low))] = True
            trial = np.where(take, np.clip(a + 0.7 * (b - c), low, high), x[k])
            if (t := f(trial)) <= v[k]:
                x[k], v[k] = trial, t
    return x[v.argmin()], float(v.min())


def adam(gradient: Callable[[Vector], Vector], x: Vector, rate: float = 0.05, rounds: int = 2000) -> Vector:
    x, m, s = np.asarray(x, float), 0.0, 0.0
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return x


def semidefinite(c: np.ndarray, a: list[np.ndarray], b: Vector, rounds: int = 5000, tol: float = 1e-8, rho: float = 1.0) -> tuple[np.ndarray, dict]:
    """min <C, X> with <A_k, X> = b_k and X positive semidefinite: alternating directions on the dual.

    Diagnostics: objective, primal and dual residuals, converged. Constraints are independent.
    """
    n, m = len(c), np.array([x.ravel() for x in a])
    b, x, s = np.asarray(b, float), np.eye(n), np.zeros((n, n))
    gram = np.linalg.inv(m @ m.T)
    primal = dual = np.inf
    for k in range(rounds):
        y = gram @ (m @ (c - s - x / rho).ravel() + b / rho)
        gap = c - (m.T @ y).reshape(n, n)
        w, q = np.linalg.eigh(gap - x / rho)
        s = (q * np.maximum(w, 0)) @ q.T
        x = (q * np.maximum(-w, 0)) @ q.T * rho
        primal = np.linalg.norm(m @ x.ravel() - b) / (1 + np.linalg.norm(b))
        dual = np.linalg.norm(gap - s) / (1 + np.linalg.norm(c))
        if max(primal, dual) < tol:
            break
    return x, {"rounds": k + 1, "objective": float((c * x).sum()), "primal": float(primal), "dual": float(dual), "converged": bool(max(primal, dual) < tol)}


def nearest_semidefinite(a: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh((a + a.T) / 2)
    return (q * np.maximum(w, 0)) @ q.T


# sampling


def metropolis(log_density: Callable[[Vector], float], x: Vector, width: float, n: int, seed: int = 0, burn: int = 500) -> tuple[np.ndarray, float]:
    """Random-walk chain (n, d) and its acceptance rate."""
    g = np.random.default_rng(seed)
    x = np.asarray(x, float)
    now, out, taken = log_density(x), np.empty((n, len(x))), 0
    for k in range(-burn, n):
        y = x + width * g.standard_normal(len(x))
        new = log_density(y)
        if math.log(max(g.random(), 1e-300)) < new - now:
            x, now, taken = y, new, taken + (k >= 0)
        if k >= 0:
            out[k] = x
    return out, taken / n


def hamiltonian(log_density: Callable[[Vector], float], slope: Callable[[Vector], Vector], x: Vector, step: float, leaps: int, n: int, seed: int = 0) -> np.ndarray:
    g = np.random.default_rng(seed)
    x, out = np.asarray(x, float), np.empty((n, len(x)))
    for k in range(n):
        p = g.standard_normal(len(x))
        y, v = verlet(slope, x, p, step, leaps)
        if math.log(max(g.random(), 1e-300)) < log_density(y) - v @ v / 2 - log_density(x) + p @ p / 2:
            x = y
        out[k] = x
    return out


def effective_size(x: Vector) -> float:
    """Of one chain: autocorrelations are added in pairs while a pair stays positive."""
    d = np.asarray(x, float) - np.mean(x)
    n = len(d)
    if n < 4 or not d.any():
        return float(n)
    f = np.fft.rfft(d, 2 * n)
    r = np.fft.irfft(f * np.conj(f))[:n]
    r, total = r / r[0], 0.0
    for k in range(1, n - 1, 2):
        if r[k] + r[k + 1] < 0:
            break
        total += r[k] + r[k + 1]
    return n / (1 + 2 * total)


def r_hat(chains: np.ndarray) -> float:
    """Between and within chains (m, n)."""
    c = np.asarray(chains, float)
    n = c.shape[1]
    within = c.var(axis=1, ddof=1).mean()
    return float(np.sqrt(((n - 1) / n * within + c.mean(axis=1).var(ddof=1)) / within))


# signals


def butterworth_sections(order: int, cutoff: float, high: bool = False) -> list[tuple[list[float], list[float]]]:
    """(b, a) of second- and first-order sections; cutoff is a share of the sampling rate below a half."""
    k = math.tan(math.pi * cutoff)
    out = []
    for i in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * i + 1) / (2 * order))
        a0 = 1 + q * k + k * k
        b = [1 / a0, -2 / a0, 1 / a0] if high else [k * k / a0, 2 * k * k / a0, k * k / a0]
        out.append((b, [1.0, 2 * (k * k - 1) / a0, (1 - q * k + k * k) / a0]))
    if order % 2:
        b = [1 / (1 + k), -1 / (1 + k)] if high else [k / (1 + k), k / (1 + k)]
        out.append((b, [1.0, (k - 1) / (k + 1)]))
    return out


def filter_sections(x: list[float], sections) -> list[float]:
    """Recursive filtering from rest: `timeseries.recursion(..., lambda v: filter_sections(v, sections))` filters every series."""
    for b, a in sections:
        past_x, past_y, out = [0.0] * (len(b) - 1), [0.0] * (len(a) - 1), []
        for v in x:
            y = b[0] * v + sum(p * q for p, q in zip(b[1:], past_x, strict=True)) - sum(p * q for p, q in zip(a[1:], past_y, strict=True))
            past_x, past_y = [v, *past_x[:-1]], [y, *past_y[:-1]]
            out.append(y)
        x = out
    return x


def welch(x: Vector, size: int, rate: float = 1.0) -> tuple[Vector, Vector]:
    """Frequencies and power density, Hann windows with half overlap; a shorter signal is one window."""
    x = np.asarray(x, float)
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [x[k : k + size] - x[k : k + size].mean() for k in range(0, len(x) - size + 1, max(size // 2, 1))]
    p = np.mean([np.abs(np.fft.rfft(w * s)) ** 2 for s in parts], axis=0) / (rate * (w * w).sum())
    p[1 : (len(p) if size % 2 else -1)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p


def envelope(x: Vector) -> Vector:
    """Size of the analytic signal."""
    n = len(x)
    f = np.fft.fft(x)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.abs(np.fft.ifft(f))
