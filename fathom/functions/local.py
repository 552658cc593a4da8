"""Small kernels for functions of one process, and ensembles that run one kernel a row group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathom.functions import lockstep
from fathom.functions.lockstep import Rows, both

Vector = np.ndarray


def bisect(f: Callable[[float], float], a: float, b: float, tol: float = 1e-12) -> float:
    """Ends may be arrays, one bracket an element; f then takes and gives arrays."""
    a, b, fa = a + 0.0 * b, b + 0.0 * a, f(a + 0.0 * b)
    if np.any(fa * f(b) > 0):
        raise ValueError("no sign change between a and b")
    while np.any(wide := b - a > tol * np.maximum(1.0, np.maximum(np.abs(a), np.abs(b)))):
        m = (a + b) / 2
        fm = f(m)
        up, zero = wide & ((fm > 0) == (fa > 0)), wide & (fm == 0)
        a, b, fa = np.where(up | zero, m, a)[()], np.where(wide & ~up | zero, m, b)[()], np.where(up, fm, fa)[()]
    return (a + b) / 2


def newton(f: Callable[[float], float], df: Callable[[float], float], x: float, rounds: int = 100, tol: float = 1e-12) -> float:
    for _ in range(rounds):
        step = f(x) / df(x)
        x -= step
        if abs(step) <= tol * max(1.0, abs(x)):
            return x
    raise RuntimeError("no convergence")


def golden_section(f: Callable[[float], float], a: float, b: float, tol: float = 1e-8) -> float:
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def simpson(f: Callable[[float], float], a: float, b: float, panels: int = 200) -> float:
    x = np.linspace(a, b, 2 * panels + 1)
    y = np.array([f(v) for v in x.tolist()])
    return float((b - a) / (6 * panels) * (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()))


def gradient(f: Callable[[Vector], float], x: Vector) -> Vector:
    """Central differences."""
    x = np.asarray(x, float)
    h = np.cbrt(np.finfo(float).eps) * np.maximum(1, np.abs(x))
    return np.array([(f(x + e) - f(x - e)) / (2 * s) for e, s in zip(np.diag(h), h, strict=True)])


def rk4(f: Callable[[float, Vector], Vector], y: Vector, t: float, end: float, steps: int) -> Vector:
    h, y = (end - t) / steps, np.asarray(y, float)
    for k in range(steps):
        s = t + k * h
        k1 = f(s, y)
        k2 = f(s + h / 2, y + h / 2 * k1)
        k3 = f(s + h / 2, y + h / 2 * k2)
        k4 = f(s + h, y + h * k3)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    return y


@both
def bfgs(f: Callable[[Vector], float], x: Vector, rounds: int = 500, tol: float = 1e-9, *, rows: Rows) -> tuple[Vector, dict]:
    """Quasi-Newton minimiser with backtracking, also for stacks (see `lockstep.both`); returns the point and diagnostics."""
    n, one = len(x), np.eye(len(x))[:, :, None]
    slope = lambda x, r: lockstep.gradient(f, x, r)

    def flat(s, r):
        done = lockstep.size(s["g"]) < tol
        return done, done

    def walk(s, r):
        x, g, h, fx = s["x"], s["g"], s["h"], s["f"]
        p = -(h * g).sum(1)
        uphill = (p * g).sum(0) >= 0
        h, p = np.where(uphill, one, h), np.where(uphill, -g, p)
        step, fall, at, left = np.ones(x.shape[1]), (g * p).sum(0), np.arange(x.shape[1]), r
        while len(at):
            far = (f(x[:, at] + step[at] * p[:, at], left) > fx[at] + 1e-4 * step[at] * fall[at]) & (step[at] > 1e-16)
            at, left = at[far], left.take(far)
            step[at] /= 2
        move = step * p
        x = x + move
        new = slope(x, r)
        y = new - g
        sy = (move * y).sum(0)
        bent = sy > 1e-14
        over = 1 / np.where(bent, sy, 1.0)
        m = one - move[:, None] * y[None] * over
        mh = (m[:, :, None] * h[None]).sum(1)
        s["h"] = np.where(bent, (mh[:, None] * m[None]).sum(2) + move[:, None] * move[None] * over, h)
        s["x"], s["g"], s["f"] = x, new, f(x, r)
        return ~bent & (np.abs(move).max(0) < 1e-14), lockstep.size(new) < 1e-5

    start = {"x": x, "g": slope(x, rows), "h": np.broadcast_to(one, (n, n, x.shape[1])), "f": f(x, rows)}
    x, told = lockstep.until(rounds, start, rows, flat, walk)
    end = lockstep.size(slope(x, rows))
    return x, {"rounds": told["rounds"], "gradient": end, "converged": told["converged"] | (end < 1e-5)}


def ensemble(df: DataFrame, id: str, f: Callable[[float, Vector, pd.Series], Vector], start: str, end: float, steps: int) -> DataFrame:
    """(id, y): rk4 of y' = f(t, y, row) from the array column `start`, each row a trajectory, rows spread over tasks."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = [rk4(lambda t, y, r=r: f(t, y, r), np.array(r[start]), 0.0, end, steps).tolist() for _, r in pdf.iterrows()]
            yield pd.DataFrame({id: pdf[id], "y": out})

    return df.mapInPandas(run, f"`{id}` {kind}, y array<double>")
