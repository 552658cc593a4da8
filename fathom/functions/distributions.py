"""Densities, probabilities, quantiles and masses as column expressions.

Parameters are numbers or columns. Outside a density's support the value is 0; a null argument gives null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _on(inside: Column, value: Column) -> Column:
    return F.when(inside, value).when(~inside, 0.0)


def ln_gamma(x) -> Column:
    """log Gamma(x) for x > 0: Stirling's series at x + 8, then the recurrence down to x."""
    x = _c(x)
    z = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7))) + 1 / (1188 * F.pow(z, F.lit(9)))
    return F.when(x > 0, (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product))


def ln_beta(a, b) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(_c(a) + _c(b))


def ln_choose(n, k) -> Column:
    return ln_gamma(_c(n) + 1) - ln_gamma(_c(k) + 1) - ln_gamma(_c(n) - _c(k) + 1)


def exponential_pdf(x: Column, rate=1.0) -> Column:
    return _on(x >= 0, _c(rate) * F.exp(-_c(rate) * x))


def uniform_cdf(x: Column, a=0.0, b=1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest((x - _c(a)) / (_c(b) - _c(a)), F.lit(0.0)), F.lit(1.0)))


def uniform_quantile(p: Column, a=0.0, b=1.0) -> Column:
    return _c(a) + p * (_c(b) - _c(a))


def gamma_pdf(x: Column, shape, rate=1.0) -> Column:
    return _on(x > 0, F.exp(_c(shape) * F.log(_c(rate)) + (_c(shape) - 1) * F.log(x) - _c(rate) * x - ln_gamma(shape)))


def beta_pdf(x: Column, a, b) -> Column:
    return _on((x > 0) & (x < 1), F.exp((_c(a) - 1) * F.log(x) + (_c(b) - 1) * F.log1p(-x) - ln_beta(a, b)))


def lognormal_pdf(x: Column, mean=0.0, sd=1.0) -> Column:
    z = (F.log(x) - _c(mean)) / _c(sd)
    return _on(x > 0, F.exp(-z * z / 2) / (x * _c(sd) * math.sqrt(2 * math.pi)))


def weibull_pdf(x: Column, shape, scale=1.0) -> Column:
    r = x / _c(scale)
    return _on(x > 0, _c(shape) / _c(scale) * F.pow(r, _c(shape) - 1) * F.exp(-F.pow(r, _c(shape))))


def cauchy_pdf(x: Column, mean=0.0, scale=1.0) -> Column:
    z = (x - _c(mean)) / _c(scale)
    return 1 / (math.pi * _c(scale) * (1 + z * z))


def cauchy_quantile(p: Column, mean=0.0, scale=1.0) -> Column:
    return _c(mean) + _c(scale) * F.tan(math.pi * (p - 0.5))


def student_t_pdf(x: Column, df) -> Column:
    n = _c(df)
    return F.exp(ln_gamma((n + 1) / 2) - ln_gamma(n / 2) - 0.5 * F.log(n * math.pi) - (n + 1) / 2 * F.log1p(x * x / n))


def chi_square_pdf(x: Column, df) -> Column:
    return gamma_pdf(x, _c(df) / 2, 0.5)


def chi_pdf(x: Column, df) -> Column:
    n = _c(df)
    return _on(x > 0, F.exp((n - 1) * F.log(x) - x * x / 2 - (n / 2 - 1) * math.log(2) - ln_gamma(n / 2)))


def f_pdf(x: Column, d1, d2) -> Column:
    a, b = _c(d1), _c(d2)
    return _on(x > 0, F.exp(a / 2 * F.log(a / b) + (a / 2 - 1) * F.log(x) - (a + b) / 2 * F.log1p(a / b * x) - ln_beta(a / 2, b / 2)))


def pareto_pdf(x: Column, shape, low=1.0) -> Column:
    return _on(x >= _c(low), _c(shape) / x * F.pow(_c(low) / x, _c(shape)))


def pareto_quantile(p: Column, shape, low=1.0) -> Column:
    return _c(low) * F.exp(-F.log1p(-p) / _c(shape))


def laplace_pdf(x: Column, mean=0.0, scale=1.0) -> Column:
    return F.exp(-F.abs(x - _c(mean)) / _c(scale)) / (2 * _c(scale))


def laplace_quantile(p: Column, mean=0.0, scale=1.0) -> Column:
    return _c(mean) - _c(scale) * F.signum(p - 0.5) * F.log1p(-2 * F.abs(p - 0.5))


def logistic_pdf(x: Column, mean=0.0, scale=1.0) -> Column:
    e = F.exp(-F.abs(x - _c(mean)) / _c(scale))
    return e / (_c(scale) * (1 + e) * (1 + e))


def logistic_quantile(p: Column, mean=0.0, scale=1.0) -> Column:
    return _c(mean) + _c(scale) * (F.log(p) - F.log1p(-p))


def gumbel_pdf(x: Column, mean=0.0, scale=1.0) -> Column:
    z = (x - _c(mean)) / _c(scale)
    return F.exp(-z - F.exp(-z)) / _c(scale)


def gumbel_quantile(p: Column, mean=0.0, scale=1.0) -> Column:
    return _c(mean) - _c(scale) * F.log(-F.log(p))


def rayleigh_pdf(x: Column, scale=1.0) -> Column:
    v = _c(scale) * _c(scale)
    return _on(x >= 0, x / v * F.exp(-x * x / (2 * v)))


def rayleigh_quantile(p: Column, scale=1.0) -> Column:
    return _c(scale) * F.sqrt(-2 * F.log1p(-p))


def triangular_pdf(x: Column, a: float, mode: float, b: float) -> Column:
    up = 2 * (x - a) / ((b - a) * (mode - a)) if mode > a else F.lit(2 / (b - a))
    down = 2 * (b - x) / ((b - a) * (b - mode)) if b > mode else F.lit(2 / (b - a))
    return _on((x >= a) & (x <= b), F.when(x < mode, up).otherwise(down))


def triangular_cdf(x: Column, a: float, mode: float, b: float) -> Column:
    up = (x - a) * (x - a) / ((b - a) * (mode - a)) if mode > a else F.lit(0.0)
    down = 1 - (b - x) * (b - x) / ((b - a) * (b - mode)) if b > mode else F.lit(1.0)
    return F.when(x <= a, 0.0).when(x >= b, 1.0).when(x < mode, up).otherwise(down)


def triangular_quantile(p: Column, a: float, mode: float, b: float) -> Column:
    return F.when(p < (mode - a) / (b - a), a + F.sqrt(p * (b - a) * (mode - a))).otherwise(b - F.sqrt((1 - p) * (b - a) * (b - mode)))


def wald_pdf(x: Column, mean, shape) -> Column:
    m, s = _c(mean), _c(shape)
    return _on(x > 0, F.sqrt(s / (2 * math.pi * x * x * x)) * F.exp(-s * (x - m) * (x - m) / (2 * m * m * x)))


def maxwell_pdf(x: Column, scale=1.0) -> Column:
    v = _c(scale) * _c(scale)
    return _on(x >= 0, math.sqrt(2 / math.pi) * x * x / (v * _c(scale)) * F.exp(-x * x / (2 * v)))


def von_mises_pdf(x: Column, mean: float, concentration: float) -> Column:
    """The normaliser is worked out while the plan is built, scaled so that it does not overflow."""
    n = 4096
    scaled = float(np.exp(concentration * (np.cos(2 * np.pi * np.arange(n) / n) - 1)).mean())
    return F.exp(concentration * (F.cos(x - mean) - 1)) / (2 * math.pi * scaled)


def gev_cdf(x: Column, mean: float, scale: float, shape: float) -> Column:
    z = (x - mean) / scale
    if abs(shape) < 1e-12:
        return F.exp(-F.exp(-z))
    s = 1 + shape * z
    return F.when(s > 0, F.exp(-F.pow(s, F.lit(-1 / shape)))).when(s <= 0, 0.0 if shape > 0 else 1.0)


def gev_pdf(x: Column, mean: float, scale: float, shape: float) -> Column:
    if abs(shape) < 1e-12:
        return gumbel_pdf(x, mean, scale)
    s = 1 + shape * (x - mean) / scale
    return _on(s > 0, F.pow(s, F.lit(-1 / shape - 1)) * F.exp(-F.pow(s, F.lit(-1 / shape))) / scale)


def gpd_cdf(x: Column, low: float, scale: float, shape: float) -> Column:
    z = (x - low) / scale
    if abs(shape) < 1e-12:
        return F.when(z <= 0, 0.0).otherwise(-F.expm1(-z))
    return F.when(z <= 0, 0.0).when(1 + shape * z <= 0, 1.0).otherwise(1 - F.pow(1 + shape * z, F.lit(-1 / shape)))


def gpd_pdf(x: Column, low: float, scale: float, shape: float) -> Column:
    z = (x - low) / scale
    if abs(shape) < 1e-12:
        return _on(z >= 0, F.exp(-z) / scale)
    return _on((z >= 0) & (1 + shape * z > 0), F.pow(1 + shape * z, F.lit(-1 / shape - 1)) / scale)


def _counts(k: Column, *more: Column) -> Column:
    ok = (k >= 0) & (k == F.floor(k))
    for m in more:
        ok = ok & m
    return ok


def binomial_pmf(k: Column, n, p: float) -> Column:
    return _on(_counts(k, k <= _c(n)), F.exp(ln_choose(n, k) + k * math.log(p) + (_c(n) - k) * math.log1p(-p)))


def geometric_cdf(k: Column, p: float) -> Column:
    """Trials up to and with the first success."""
    return F.when(k < 1, 0.0).otherwise(-F.expm1(F.floor(k) * math.log1p(-p)))


def neg_binomial_pmf(k: Column, r, p: float) -> Column:
    """k failures before the r-th success."""
    return _on(_counts(k), F.exp(ln_gamma(k + _c(r)) - ln_gamma(k + 1) - ln_gamma(r) + _c(r) * math.log(p) + k * math.log1p(-p)))


def hypergeometric_pmf(k: Column, total: int, marked: int, drawn: int) -> Column:
    value = F.exp(ln_choose(marked, k) + ln_choose(total - marked, drawn - k) - ln_choose(total, drawn))
    return _on(_counts(k, k <= min(marked, drawn), k >= drawn - (total - marked)), value)


def beta_binomial_pmf(k: Column, n, a, b) -> Column:
    return _on(_counts(k, k <= _c(n)), F.exp(ln_choose(n, k) + ln_beta(k + _c(a), _c(n) - k + _c(b)) - ln_beta(a, b)))


def zipf_pmf(k: Column, exponent: float, n: int) -> Column:
    total = float((np.arange(1, n + 1, dtype=float) ** -exponent).sum())
    return _on(_counts(k, k >= 1, k <= n), F.pow(k, F.lit(-exponent)) / total)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def multinomial_pmf(counts: Column, p: Column) -> Column:
    """Of an array of counts, with an array of probabilities."""
    terms = F.zip_with(counts, p, lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) - ln_gamma(k.cast("double") + 1))
    return F.exp(ln_gamma(_sum(counts) + 1) + _sum(terms))


def dirichlet_log_pdf(x: Column, alpha: list[float]) -> Column:
    constant = math.lgamma(sum(alpha)) - sum(map(math.lgamma, alpha))
    return F.lit(constant) + sum((F.log(F.get(x, F.lit(k))) * (a - 1) for k, a in enumerate(alpha)), F.lit(0.0))


def dirichlet_moments(alpha: list[float]) -> list[tuple[float, float]]:
    """Mean and variance of each share."""
    s = sum(alpha)
    return [(a / s, a * (s - a) / (s * s * (s + 1))) for a in alpha]


def mvnormal_log_pdf(xs: list[Column], mean: list[float], covariance) -> Column:
    """The precision matrix is worked out while the plan is built; a quadratic form in the columns stays."""
    low = np.linalg.cholesky(np.asarray(covariance, float))
    inv = np.linalg.inv(low)
    total = F.lit(-float(np.log(np.diag(low)).sum()) - len(xs) / 2 * math.log(2 * math.pi))
    for row in inv:
        z = sum(((x - m) * float(a) for x, m, a in zip(xs, mean, row, strict=True) if a), F.lit(0.0))
        total = total - z * z / 2
    return total


def mixture_pdf(x: Column, parts: list[tuple[float, float, float]]) -> Column:
    """Of normal parts (weight, mean, standard deviation)."""
    out = F.lit(0.0)
    for w, m, s in parts:
        z = (x - m) / s
        out = out + w / (s * math.sqrt(2 * math.pi)) * F.exp(-z * z / 2)
    return out
