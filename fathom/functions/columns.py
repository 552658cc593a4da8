"""Closed-form scalar functions as column expressions: they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAU = 2 * math.pi


def normal_pdf(x: Column, mean=0.0, sd=1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (F.lit(sd) * math.sqrt(_TAU))


def exponential_cdf(x: Column, rate: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(-F.expm1(-x * rate))


def exponential_quantile(p: Column, rate: float) -> Column:
    return -F.log1p(-p) / rate


def uniform_pdf(x: Column, a: float, b: float) -> Column:
    return F.when((x >= a) & (x <= b), 1.0 / (b - a)).otherwise(0.0)


def weibull_cdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(-F.expm1(-F.pow(x / scale, F.lit(shape))))


def weibull_quantile(p: Column, shape: float, scale: float) -> Column:
    return scale * F.pow(-F.log1p(-p), F.lit(1 / shape))


def pareto_cdf(x: Column, shape: float, low: float) -> Column:
    return F.when(x < low, 0.0).otherwise(1 - F.pow(F.lit(low) / x, F.lit(shape)))


def logistic_cdf(x: Column, mean=0.0, scale=1.0) -> Column:
    return 1 / (1 + F.exp(-(x - mean) / scale))


def laplace_cdf(x: Column, mean=0.0, scale=1.0) -> Column:
    z = (x - mean) / scale
    return F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2)


def cauchy_cdf(x: Column, mean=0.0, scale=1.0) -> Column:
    return F.atan((x - mean) / scale) / math.pi + 0.5


def gumbel_cdf(x: Column, mean=0.0, scale=1.0) -> Column:
    return F.exp(-F.exp(-(x - mean) / scale))


def rayleigh_cdf(x: Column, scale: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(-F.expm1(-x * x / (2 * scale * scale)))


def poisson_pmf(k: Column, mean: float) -> Column:
    """Exact up to k = 20, the range of Spark's factorial; null beyond."""
    return F.when(k < 0, 0.0).otherwise(F.exp(F.lit(-mean)) * F.pow(F.lit(mean), k) / F.factorial(k))


def geometric_pmf(k: Column, p: float) -> Column:
    return F.when(k < 1, 0.0).otherwise(p * F.pow(F.lit(1 - p), k - 1))


def sigmoid(x: Column) -> Column:
    return logistic_cdf(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots, smaller first, as an array; empty if there is none."""
    d = b * b - 4 * a * c
    q = -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(d)) / 2
    two = F.array(q / a, F.when(q == 0, 0.0).otherwise(c / q))
    return F.when(a == 0, F.when(b == 0, F.array().cast("array<double>")).otherwise(F.array(-c / b))).when(d < 0, F.array().cast("array<double>")).otherwise(F.array_sort(F.array_distinct(two)))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner's rule; coefficients from the constant on."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + float(c)
    return out


def complex_polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def complex_quotient(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    n = br * br + bi * bi
    return (ar * br + ai * bi) / n, (ai * br - ar * bi) / n


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def triangle_area(ax, ay, bx, by, cx, cy) -> Column:
    return F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2


def in_box(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def sum_uncertainty(*sd: Column) -> Column:
    return F.sqrt(sum((s * s for s in sd[1:]), sd[0] * sd[0]))


def hash_uniform(*key: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on seed and key alone, so retried tasks draw the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)).cast("double") / float(1 << 53)


def nonzero(x: Column) -> Column:
    """x, or null where it is 0, so that a quotient by it is null there."""
    return F.when(x != 0, x)
