"""Further integrators and boundary-value solvers on small grids, for one instance a row (see `solvers.each`)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fathom.functions.local import bisect, rk4
from fathom.functions.lockstep import jacobian, solve
from fathom.functions.solvers import tridiagonal

Vector = np.ndarray
Field = Callable[[float, Vector], Vector]


def euler(f: Field, y: Vector, t: float, end: float, steps: int) -> Vector:
    h, y = (end - t) / steps, np.asarray(y, float)
    for k in range(steps):
        y = y + h * f(t + k * h, y)
    return y


def bogacki_shampine(f: Field, y: Vector, t: float, end: float, tol: float = 1e-7, most: int = 200_000) -> tuple[Vector, int]:
    """Third order with second-order error control; returns the state and the number of steps tried. States may be stacks,
    instances last, each with its own steps; `end` may then be an array."""
    y, h, n = np.asarray(y, float), (end - t) / 50, 0
    t, k1 = t + 0.0 * h, f(t, y)
    while np.any(going := (end - t) * np.sign(h) > 0):
        if n == most:
            raise RuntimeError(f"more than {most} steps")
        n += 1
        h = np.where(h > 0, np.minimum(h, end - t), np.maximum(h, end - t))
        k2 = f(t + h / 2, y + h / 2 * k1)
        k3 = f(t + 3 * h / 4, y + 3 * h / 4 * k2)
        new = y + h * (2 * k1 + 3 * k2 + 4 * k3) / 9
        k4 = f(t + h, new)
        off = np.max(np.abs(h * (-5 * k1 / 72 + k2 / 12 + k3 / 9 - k4 / 8)) / (1 + np.abs(new)), axis=0)
        taken = going & (off <= tol)
        t, y, k1 = np.where(taken, t + h, t), np.where(taken, new, y), np.where(taken, k4, k1)
        h = h * np.minimum(4.0, np.maximum(0.2, 0.9 * (tol / np.maximum(off, 1e-300)) ** (1 / 3)))
    return y, n


def adams_bashforth(f: Field, y: Vector, t: float, end: float, steps: int) -> Vector:
    """Four slopes back, begun by the classical method."""
    h, y = (end - t) / steps, np.asarray(y, float)
    past = [f(t, y)]
    for k in range(steps):
        if len(past) < 4:
            y = rk4(f, y, t + k * h, t + (k + 1) * h, 1)
        else:
            a, b, c, d = past[-1], past[-2], past[-3], past[-4]
            y = y + h / 24 * (55 * a - 59 * b + 37 * c - 9 * d)
        past = [*past[-3:], f(t + (k + 1) * h, y)]
    return y


def rosenbrock(f: Field, y: Vector, t: float, end: float, steps: int) -> Vector:
    """Second order and damping for stiff systems: two linear solves a step, no iteration. States may be stacks, instances last."""
    h, y, g = (end - t) / steps, np.asarray(y, float), 1 + 1 / np.sqrt(2)
    for k in range(steps):
        s = t + k * h
        base = f(s, y)
        ft = (f(s + 1e-7, y) - base) / 1e-7
        m = -h * g * jacobian(lambda z, s=s: f(s, z), y, base)
        for i in range(len(y)):
            m[i, i] += 1
        k1 = solve(m, base + h * g * ft)
        k2 = solve(m, f(s + h, y + h * k1) - 2 * k1 - h * g * ft)
        y = y + h * (3 * k1 + k2) / 2
    return y


def heat_2d(u: np.ndarray, h: float, dt: float, steps: int, diffusion: float = 1.0) -> np.ndarray:
    """Alternating directions (Peaceman and Rachford); edges keep their values."""
    u, r = np.array(u, float), diffusion * dt / (2 * h * h)

    def half(v: np.ndarray) -> np.ndarray:
        """Implicit along the first axis, explicit along the second."""
        out, n = v.copy(), v.shape[0] - 2
        low, mid = np.full(n, -r), np.full(n, 1 + 2 * r)
        for j in range(1, v.shape[1] - 1):
            right = v[1:-1, j] + r * (v[1:-1, j - 1] - 2 * v[1:-1, j] + v[1:-1, j + 1])
            right[0] += r * v[0, j]
            right[-1] += r * v[-1, j]
            out[1:-1, j] = tridiagonal(low, mid, low, right)
        return out

    for _ in range(steps):
        u = half(half(u).T).T
    return u


def wave_2d(u: np.ndarray, velocity: np.ndarray, h: float, dt: float, steps: int, speed: float = 1.0) -> np.ndarray:
    """Leapfrog; edges keep their values; speed * dt / h must be below 1 / sqrt(2)."""
    if speed * dt / h > 0.5**0.5:
        raise ValueError("the step is too long for the grid")

    def bend(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        out[1:-1, 1:-1] = (v[2:, 1:-1] + v[:-2, 1:-1] + v[1:-1, 2:] + v[1:-1, :-2] - 4 * v[1:-1, 1:-1]) * (speed * dt / h) ** 2
        return out

    old, now = np.array(u, float), None
    for _ in range(steps):
        if now is None:
            step = dt * np.array(velocity, float)
            step[[0, -1]], step[:, [0, -1]] = 0, 0
            now = old + step + bend(old) / 2
        else:
            old, now = now, 2 * now - old + bend(now)
    return old if now is None else now


def shooting(f: Callable[[float, float, float], float], a: float, b: float, ya: float, yb: float, low: float, high: float, steps: int = 400) -> float:
    """The slope at a, between low and high, with which y'' = f(t, y, y') goes from ya to yb. Ends and values may be arrays."""
    end = lambda s: rk4(lambda t, v: np.array([v[1], f(t, v[0], v[1])]), np.array([ya + 0.0 * s, s]), a, b, steps)[0] - yb
    same = 0.0 * (a + b + ya + yb)
    return bisect(end, low + same, high + same)


def chebyshev_matrix(n: int) -> tuple[Vector, np.ndarray]:
    """Nodes cos(pi k / n) and the matrix that differentiates polynomials through them."""
    x = np.cos(np.pi * np.arange(n + 1) / n)
    c = np.where((np.arange(n + 1) == 0) | (np.arange(n + 1) == n), 2.0, 1.0) * (-1.0) ** np.arange(n + 1)
    d = np.outer(c, 1 / c) / (x[:, None] - x[None, :] + np.eye(n + 1))
    return x, d - np.diag(d.sum(1))


def chebyshev_bvp(p: Callable[[Vector], Vector], q: Callable[[Vector], Vector], r: Callable[[Vector], Vector], a: float, b: float, ya: float, yb: float, n: int = 32) -> tuple[Vector, Vector]:
    """Nodes (ascending) and values of y'' + p y' + q y = r with given ends. Ends and values may be arrays: nodes are then the
    first axis, instances the last."""
    shape = np.shape(a + b + ya + yb)
    a, b, ya, yb = (np.broadcast_to(np.asarray(v, float), shape).reshape(-1) for v in (a, b, ya, yb))
    x, d = chebyshev_matrix(n)
    t = (a + b) / 2 + (b - a) / 2 * x[:, None]
    d = d * (2 / (b - a))[:, None, None]
    # a function may give one number for all nodes
    at = lambda f: np.broadcast_to(np.asarray(f(t), float), t.shape)
    m = d @ d + at(p).T[:, :, None] * d + at(q).T[:, :, None] * np.eye(n + 1)
    right = at(r).T.copy()
    for k, v in ((0, yb), (n, ya)):
        m[:, k], right[:, k] = np.eye(n + 1)[k], v
    y = np.linalg.solve(m, right[:, :, None])[:, :, 0].T
    return t[::-1].reshape(n + 1, *shape), y[::-1].reshape(n + 1, *shape)
