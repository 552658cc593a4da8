"""Interpolation through fixed knots, as columns: polynomials, cubic and Akima splines, radial functions, bilinear patches.

Knots are few and known while planning: coefficients are worked out once, and a column evaluates them in generated code.
Knot abscissas must ascend strictly. Beyond the knots splines go on with their first or last piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Numbers = Sequence[float]


def _knots(x: Numbers, y: Numbers, least: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y) or len(x) < least:
        raise ValueError(f"{least} knots at least, as many values as knots")
    if not (np.diff(x) > 0).all():
        raise ValueError("knots must ascend")
    return x, y


def _add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def lagrange(at: Column, x: Numbers, y: Numbers) -> Column:
    """The polynomial through all knots, in barycentric form; a knot gives its value."""
    x, y = _knots(x, y, 1)
    w = np.array([1 / np.prod(np.delete(x[i] - x, i)) for i in range(len(x))])
    up = _add([F.lit(float(a * b)) / (at - float(c)) for a, b, c in zip(w, y, x, strict=True)])
    down = _add([F.lit(float(a)) / (at - float(c)) for a, c in zip(w, x, strict=True)])
    out = None
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        out = F.when(at == a, F.lit(b)) if out is None else out.when(at == a, F.lit(b))
    return out.otherwise(up / down)


def neville(at: Column, x: Numbers, y: Numbers) -> Column:
    """The same polynomial by Neville's scheme of ever longer ranges of knots."""
    x, y = _knots(x, y, 1)
    p = [F.lit(float(v)) for v in y]
    for k in range(1, len(x)):
        p = [((at - float(x[i + k])) * p[i] - (at - float(x[i])) * p[i + 1]) / float(x[i] - x[i + k]) for i in range(len(x) - k)]
    return p[0]


class Pieces:
    """Cubic pieces between knots: c[i] are the coefficients of 1, d, d**2, d**3 with d = x - knot i."""

    def __init__(self, x: np.ndarray, c: np.ndarray):
        self.x, self.c = x, c

    def _choose(self, at: Column, f) -> Column:
        out = None
        for i in range(len(self.c) - 1):
            hit = at < float(self.x[i + 1])
            out = F.when(hit, f(i)) if out is None else out.when(hit, f(i))
        last = f(len(self.c) - 1)
        return last if out is None else F.when(at.isNotNull(), out.otherwise(last))

    def value(self, at: Column) -> Column:
        def one(i: int) -> Column:
            d, (a, b, c, e) = at - float(self.x[i]), self.c[i].tolist()
            return ((d * e + c) * d + b) * d + a

        return self._choose(at, one)

    def slope(self, at: Column) -> Column:
        def one(i: int) -> Column:
            d, (_, b, c, e) = at - float(self.x[i]), self.c[i].tolist()
            return (d * (3 * e) + 2 * c) * d + b

        return self._choose(at, one)


def _hermite(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> Pieces:
    h = np.diff(x)
    m = np.diff(y) / h
    return Pieces(x, np.stack([y[:-1], s[:-1], (3 * m - 2 * s[:-1] - s[1:]) / h, (s[:-1] + s[1:] - 2 * m) / h**2], 1))


def cubic_spline(x: Numbers, y: Numbers) -> Pieces:
    """The natural cubic spline: no curvature at the ends."""
    x, y = _knots(x, y, 2)
    h, n = np.diff(x), len(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    return Pieces(x, np.stack([y[:-1], np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)], 1))


def akima_spline(x: Numbers, y: Numbers) -> Pieces:
    """Akima's spline: slopes weigh the neighbouring differences, so a bump stays local."""
    x, y = _knots(x, y, 5)
    m = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    w1, w2 = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    s = np.where(w1 + w2 > 0, (w1 * m[1:-2] + w2 * m[2:-1]) / np.where(w1 + w2 > 0, w1 + w2, 1), (m[1:-2] + m[2:-1]) / 2)
    return _hermite(x, y, s)


KERNELS = {
    "gaussian": (lambda r: np.exp(-(r**2)), lambda r: F.exp(-r * r)),
    "multiquadric": (lambda r: np.sqrt(1 + r**2), lambda r: F.sqrt(1 + r * r)),
    "inverse": (lambda r: 1 / np.sqrt(1 + r**2), lambda r: 1 / F.sqrt(1 + r * r)),
    "linear": (lambda r: r, lambda r: r),
    "plate": (lambda r: np.where(r > 0, r**2 * np.log(np.where(r > 0, r, 1)), 0.0), lambda r: F.when(r > 0, r * r * F.ln(r)).otherwise(0.0)),
}


def radial(at: Sequence[Column], points: Sequence[Numbers], values: Numbers, kernel: str = "gaussian", width: float = 1.0) -> Column:
    """The sum of radial functions around points that takes the given values there."""
    p, v = np.asarray(points, float), np.asarray(values, float)
    number, column = KERNELS[kernel]
    w = np.linalg.solve(number(np.linalg.norm(p[:, None] - p[None], axis=2) / width), v)
    distance = lambda q: F.sqrt(_add([(a - float(b)) * (a - float(b)) for a, b in zip(at, q, strict=True)])) / width
    return _add([float(k) * column(distance(q)) for k, q in zip(w, p, strict=True)])


def bilinear(x: Column, y: Column, xs: Numbers, ys: Numbers, grid: Sequence[Numbers]) -> Column:
    """Bilinear patches over a grid of values (a row for each of xs); null outside the grid."""
    xs, ys, g = np.asarray(xs, float), np.asarray(ys, float), np.asarray(grid, float)
    out = F.when(F.lit(False), F.lit(0.0))
    for i in range(len(xs) - 1):
        for j in range(len(ys) - 1):
            u, v = (x - float(xs[i])) / float(xs[i + 1] - xs[i]), (y - float(ys[j])) / float(ys[j + 1] - ys[j])
            a, b, c, d = (float(g[p, q]) for p, q in ((i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1)))
            inside = x.between(float(xs[i]), float(xs[i + 1])) & y.between(float(ys[j]), float(ys[j + 1]))
            out = out.when(inside, (1 - u) * (1 - v) * a + u * (1 - v) * b + (1 - u) * v * c + u * v * d)
    return out
