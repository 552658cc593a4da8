"""Special functions and distributions in numpy, and as Arrow-vectorised column functions.

Survival functions are computed directly, so small p-values keep their digits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import quantiles

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])
_EPS, _TINY = 1e-15, 1e-300


def ln_gamma(x):
    return _LGAMMA(x)


def erf(x):
    return 1 - _ERFC(x)


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    for _ in range(10_000):
        n += 1
        term *= x / n
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = d * c
        h *= step
        if abs(step - 1) < _EPS:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 0.0
    return _gamma_series(a, x) if x < a + 1 else 1 - _gamma_fraction(a, x)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 1.0
    return 1 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x >= 0 else 1.0


def ks_sf(d: float, n: float) -> float:
    """Asymptotic Kolmogorov survival with effective size n."""
    s = math.sqrt(n)
    z = (s + 0.12 + 0.11 / s) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))) if z > 0.2 else 1.0


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function: bisection bracket, Newton finish."""
    if not 0 < p < 1:
        return {0: -math.inf, 1: math.inf}.get(p, math.nan)
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if 1 - normal_sf(mid) < p if p > 0.5 else normal_sf(-mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _column(f, *args) -> Column:
    """f of columns or numbers, row-wise in Arrow batches; null in, null out."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=float)

    # pandas_udf needs a fixed number of arguments
    g = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(args)]
    g.__annotations__ = dict.fromkeys(g.__code__.co_varnames[: len(args)], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(g, "double")(*(a if isinstance(a, Column) else F.lit(float(a)) if isinstance(a, (int, float)) else F.col(a) for a in args))


#: The same functions on whole arrays; null where they are undefined.
_ARRAYS = {
    "ln_gamma": quantiles.ln_gamma,
    "gamma_p": quantiles.gamma_p,
    "gamma_q": quantiles.gamma_q,
    "beta_i": quantiles.beta_i,
    "normal_sf": lambda z: quantiles.normal_cdf(-z),
    "t_sf2": lambda t, df: quantiles.beta_i(df / 2, 0.5, df / (df + t * t)),
    "chi2_sf": lambda x, df: quantiles.gamma_q(df / 2, np.maximum(x, 0) / 2),
    "f_sf": lambda x, d1, d2: quantiles.beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(x, 0))),
    "normal_quantile": quantiles.normal_quantile,
}


def column(name: str, *args) -> Column:
    """A function of this module as a column expression: column("f_sf", "f_statistic", "df_between", "df_within")."""
    if name in _ARRAYS:
        return quantiles.column(_ARRAYS[name], *(F.col(a) if isinstance(a, str) else a for a in args))
    return _column(globals()[name], *args)
