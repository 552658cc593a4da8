"""Complex numbers as pairs of columns (re, im); principal branches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Complex = tuple[Column, Column]


def add(a: Complex, b: Complex) -> Complex:
    return a[0] + b[0], a[1] + b[1]


def mul(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def div(a: Complex, b: Complex) -> Complex:
    d = b[0] * b[0] + b[1] * b[1]
    return (a[0] * b[0] + a[1] * b[1]) / d, (a[1] * b[0] - a[0] * b[1]) / d


def scale(a: Complex, k) -> Complex:
    return a[0] * k, a[1] * k


def settled(a: Complex, ulps: int = 32) -> Complex:
    """A part that is below the rounding error of the modulus, 2^-53 a step, is zero: what is left where terms cancel."""
    least = modulus(a) * (ulps * 2.0**-53)
    return tuple(F.when(F.abs(x) <= least, 0.0).otherwise(x) for x in a)


def conjugate(a: Complex) -> Complex:
    return a[0], -a[1]


def modulus(a: Complex) -> Column:
    return F.hypot(a[0], a[1])


def argument(a: Complex) -> Column:
    return F.atan2(a[1], a[0])


def from_polar(r: Column, angle: Column) -> Complex:
    return r * F.cos(angle), r * F.sin(angle)


def exp(a: Complex) -> Complex:
    return from_polar(F.exp(a[0]), a[1])


def log(a: Complex, branch: int = 0) -> Complex:
    return F.log(modulus(a)), argument(a) + 2 * F.pi() * branch


def sqrt(a: Complex) -> Complex:
    return from_polar(F.sqrt(modulus(a)), argument(a) / 2)


def power(a: Complex, n: float) -> Complex:
    return from_polar(F.pow(modulus(a), F.lit(float(n))), argument(a) * n)


def sin(a: Complex) -> Complex:
    return F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])


def cos(a: Complex) -> Complex:
    return F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])


def tan(a: Complex) -> Complex:
    return div(sin(a), cos(a))


def sinh(a: Complex) -> Complex:
    return F.sinh(a[0]) * F.cos(a[1]), F.cosh(a[0]) * F.sin(a[1])


def cosh(a: Complex) -> Complex:
    return F.cosh(a[0]) * F.cos(a[1]), F.sinh(a[0]) * F.sin(a[1])


def polynomial(a: Complex, coefficients: list[complex]) -> Complex:
    """Horner's rule; coefficients from the constant up."""
    out: Complex = (F.lit(0.0), F.lit(0.0))
    for c in reversed(coefficients):
        c = complex(c)
        out = add(mul(out, a), (F.lit(c.real), F.lit(c.imag)))
    return out


def mobius(a: Complex, p: complex, q: complex, r: complex, s: complex) -> Complex:
    """(p a + q) / (r a + s)."""
    return div(polynomial(a, [q, p]), polynomial(a, [s, r]))


def joukowski(a: Complex) -> Complex:
    return add(a, div((F.lit(1.0), F.lit(0.0)), a))


def sub(a: Complex, b: Complex) -> Complex:
    return a[0] - b[0], a[1] - b[1]


def _lit(z: complex) -> Complex:
    z = complex(z)
    return F.lit(z.real), F.lit(z.imag)


def _times_i(a: Complex) -> Complex:
    return -a[1], a[0]


def asin(a: Complex) -> Complex:
    """-i log(i z + sqrt(1 - z^2))."""
    w = log(add(_times_i(a), sqrt(sub(_lit(1), mul(a, a)))))
    return w[1], -w[0]


def acos(a: Complex) -> Complex:
    w = asin(a)
    return F.lit(math.pi / 2) - w[0], -w[1]


def atan(a: Complex) -> Complex:
    """-i/2 log((i - z) / (i + z)), with poles at i and -i."""
    w = log(div(sub(_lit(1j), a), add(_lit(1j), a)))
    return scale((w[1], -w[0]), 0.5)


def asinh(a: Complex) -> Complex:
    return log(add(a, sqrt(add(mul(a, a), _lit(1)))))


def acosh(a: Complex) -> Complex:
    return log(add(a, mul(sqrt(add(a, _lit(1))), sqrt(sub(a, _lit(1))))))


def quadratic_roots(a: Complex, b: Complex, c: Complex) -> tuple[Complex, Complex]:
    """Both roots of a z^2 + b z + c."""
    root = sqrt(sub(mul(b, b), scale(mul(a, c), 4)))
    return tuple(div(add(scale(b, -1), r), scale(a, 2)) for r in (root, scale(root, -1)))


def polynomial_slope(coefficients: list[complex]) -> list[complex]:
    """Coefficients (ascending powers) of the derivative."""
    return [k * c for k, c in enumerate(coefficients)][1:] or [0]


def polynomial_product(a: list[complex], b: list[complex]) -> list[complex]:
    return np.convolve(a, b).tolist()


def polynomial_roots(coefficients: list[complex]) -> list[complex]:
    """All roots of a polynomial of ascending powers, as eigenvalues of its companion matrix."""
    return sorted(np.roots(np.asarray(coefficients)[::-1]).tolist(), key=lambda z: (round(z.real, 9), round(z.imag, 9)))


def partial_fractions(numerator: list[complex], poles: list[complex]) -> list[complex]:
    """Residues of numerator / product of (z - pole) at distinct poles."""
    value = lambda z: sum(c * z**k for k, c in enumerate(numerator))
    return [value(p) / np.prod([p - q for q in poles if q != p]) for p in poles]


def blaschke(a: Complex, zeros: list[complex]) -> Complex:
    """Product of (z - w) / (1 - conj(w) z)."""
    out = _lit(1)
    for w in map(complex, zeros):
        out = mul(out, div(sub(a, _lit(w)), sub(_lit(1), mul(_lit(w.conjugate()), a))))
    return out


def joukowski_inverse(w: Complex) -> Complex:
    """The z of w = z + 1 / z outside the unit circle."""
    root = sqrt(sub(mul(w, w), _lit(4)))
    p, q = scale(add(w, root), 0.5), scale(sub(w, root), 0.5)
    outer = modulus(p) >= modulus(q)
    return F.when(outer, p[0]).otherwise(q[0]), F.when(outer, p[1]).otherwise(q[1])


def winding_number(a: Complex, polygon: list[complex]) -> Column:
    """How often a closed polygon goes around each point."""
    total = F.lit(0.0)
    for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        turn = div(sub(_lit(q), a), sub(_lit(p), a))
        total = total + argument(turn)
    return F.round(total / (2 * math.pi)).cast("int")


Function = Callable[[complex], complex]


def path_integral(f: Function, path: list[complex], points: int = 16) -> complex:
    """Gauss-Legendre along each segment of a path."""
    x, w = np.polynomial.legendre.leggauss(points)
    return sum((q - p) / 2 * sum(k * f((p + q) / 2 + (q - p) / 2 * u) for u, k in zip(x, w, strict=True)) for p, q in zip(path, path[1:], strict=False))


def circular_integral(f: Function, centre: complex, radius: float, points: int = 256) -> complex:
    """Equal steps around a circle, which converge fast for analytic functions."""
    z = radius * np.exp(2j * np.pi * np.arange(points) / points)
    return complex(sum(f(centre + u) * 1j * u for u in z) * 2 * np.pi / points)


def residue(f: Function, pole: complex, radius: float = 1e-1) -> complex:
    """Of a pole of any order with no other pole within radius."""
    return circular_integral(f, pole, radius) / (2j * math.pi)


def argument_principle(f: Function, slope: Function, centre: complex, radius: float) -> int:
    """Zeros less poles inside a circle."""
    return round((circular_integral(lambda z: slope(z) / f(z), centre, radius, 1024) / (2j * math.pi)).real)


def newton(f: Function, slope: Function, z: complex, rounds: int = 100, tol: float = 1e-13) -> complex:
    for _ in range(rounds):
        step = f(z) / slope(z)
        z -= step
        if abs(step) <= tol * max(1, abs(z)):
            return z
    raise RuntimeError("no convergence")
