"""Autoregressive and variance models of series: lag products are one grouped aggregate, only recursions run in Python.

A series is the rows of `by` in the order of `order`; rows with a null value are left out. Series too short for a model
give nulls, as do constant ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need
from fathom.operators.timeseries import acf, ordered


def _levinson(r: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Coefficients and relative error variance of every order up to len(r), from autocorrelations r_1, r_2, ..."""
    phi, err, all_phi, all_err = np.zeros(0), 1.0, [], []
    for k in range(len(r)):
        last = (r[k] - phi @ r[:k][::-1]) / err if err > 1e-300 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        err *= 1 - last * last
        all_phi.append(phi)
        all_err.append(err)
    return all_phi, all_err


def _lag_table(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    r = acf(df, value, by, order, lags).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", "r"))).alias("_r"))
    base = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(value).alias("n"))
    return base.join(r.withColumn("_r", F.col("_r.r")), by, "left")


def _per_series(x: DataFrame, by: list[str], fields: str, f) -> DataFrame:
    keys = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by)
    names = [p.split()[0] for p in fields.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [f(r) for r in pdf.itertuples(index=False)]
            out = pdf[by].copy()
            for k, n in enumerate(names):
                out[n] = pd.Series([row[k] for row in rows], index=out.index, dtype=object)
            yield out

    return x.mapInPandas(run, f"{keys}, {fields}")


def partial_autocorrelation(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """(by, lag, pacf) by the Durbin-Levinson recursion on the autocorrelations."""
    x = _lag_table(df, value, by, order, lags).select(*by, F.col("_r").alias("r"))

    def one(row):
        r = _usable(row.r)
        return ([float(p[-1]) for p in _levinson(r)[0]] if r is not None else None,)

    out = _per_series(x, by, "p array<double>", one)
    return out.select(*by, F.posexplode("p").alias("lag", "pacf")).withColumn("lag", F.col("lag") + 1)


def _usable(r) -> np.ndarray | None:
    if r is None or any(v is None or not math.isfinite(v) for v in r):
        return None
    return np.asarray(r, float)


def fit_ar(df: DataFrame, value: str, by: list[str], order: list[str], p: int, best: bool = False) -> DataFrame:
    """Yule-Walker AR model a series: (by, mean, phi, sigma2, p, aic, bic); `best` takes the order up to p of least AIC."""
    need(p >= 1, "order is at least 1")
    x = _lag_table(df, value, by, order, p).select(*by, "mean", "variance", "n", F.col("_r").alias("r"))

    def one(row):
        r = _usable(row.r)
        if r is None or not row.variance or row.n <= p:
            return (row.mean, None, None, None, None, None)
        phis, errs = _levinson(r)
        fits = []
        for k in range(1, p + 1):
            s2 = max(row.variance * errs[k - 1], 1e-300)
            ll = -row.n / 2 * (math.log(2 * math.pi * s2) + 1)
            fits.append((2 * (k + 1) - 2 * ll, k, s2, math.log(row.n) * (k + 1) - 2 * ll))
        aic, k, s2, bic = min(fits) if best else fits[-1]
        return (row.mean, phis[k - 1].tolist(), s2, k, aic, bic)

    return _per_series(x, by, "mean double, phi array<double>, sigma2 double, p int, aic double, bic double", one)


def forecast_ar(df: DataFrame, value: str, by: list[str], order: list[str], p: int, steps: int) -> DataFrame:
    """(by, h, forecast) of an AR(p) model; a series of p values or fewer gets its mean."""
    models = fit_ar(df, value, by, order, p)
    desc = W.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    tail = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(desc)).where(F.col("_k") <= p)
    tail = tail.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("_k")).alias("k"), F.col(value).cast("double").alias("v")))).alias("_t"))
    x = models.join(tail.withColumn("tail", F.col("_t.v")), by).select(*by, "mean", "phi", "tail")

    def one(row):
        if row.phi is None:
            return ([row.mean] * steps,)
        phi, past = np.asarray(row.phi), [v - row.mean for v in row.tail]
        for _ in range(steps):
            past.append(float(phi @ np.array(past[-len(phi) :])[::-1]))
        return ([row.mean + v for v in past[-steps:]],)

    out = _per_series(x, by, "f array<double>", one)
    return out.select(*by, F.posexplode("f").alias("h", "forecast")).withColumn("h", F.col("h") + 1)


def kpss(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """(by, n, kpss): level stationarity, long-run variance with Bartlett weights."""
    d = df.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    w = ordered(by, order)
    d = d.withColumn("_s", F.sum("_e").over(w.rowsBetween(W.unboundedPreceding, 0)))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_l{k}", F.lag("_e", k).over(w))
    long_run = F.sum(F.col("_e") * F.col("_e")) + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    n = F.count("_e")
    return d.groupBy(*by).agg(n.alias("n"), F.try_divide(F.sum(F.col("_s") * F.col("_s")), n * long_run).alias("kpss"))


def _ols1(y: Column, x: Column) -> dict[str, Column]:
    return {"slope": F.regr_slope(y, x), "sxx": F.regr_sxx(y, x), "syy": F.regr_syy(y, x), "n": F.regr_count(y, x)}


def dickey_fuller(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, slope, t): regression of the change on the level before it, with an intercept; t far below zero is stationary."""
    w = ordered(by, order)
    d = df.where(F.col(value).isNotNull()).withColumn("_x", F.lag(value).over(w)).withColumn("_y", F.col(value) - F.col("_x")).where("_x IS NOT NULL")
    g = d.groupBy(*by).agg(*(c.alias(k) for k, c in _ols1(F.col("_y"), F.col("_x")).items()))
    se = F.sqrt(F.try_divide((F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")), (F.col("n") - 2) * F.col("sxx")))
    return g.select(*by, "n", "slope", F.try_divide(F.col("slope"), se).alias("t"))


def ewma_anomalies(df: DataFrame, value: str, by: list[str], order: list[str], key: list[str], alpha: float, limit: float) -> DataFrame:
    """Rows with deviation (value less the average before it, in sample deviations of the series) and anomaly."""
    from fathom.operators.timeseries import ema

    e = ema(df, value, by, order, alpha, key)
    sd = F.stddev_samp(value).over(W.partitionBy(*by))
    d = F.coalesce(F.try_divide(F.col(value) - F.lag("ema").over(ordered(by, order)), sd), F.lit(0.0))
    return e.withColumn("deviation", d).withColumn("anomaly", F.abs("deviation") > limit)


def granger_one_lag(df: DataFrame, x: str, y: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, f): whether x one step before adds to y one step before in predicting y; one aggregate of centred products."""
    w = ordered(by, order)
    d = df.select(*by, F.col(y).cast("double").alias("_y"), F.lag(F.col(y).cast("double")).over(w).alias("_a"), F.lag(F.col(x).cast("double")).over(w).alias("_b")).dropna()
    pairs = [("_y", "_y"), ("_a", "_a"), ("_b", "_b"), ("_a", "_y"), ("_b", "_y"), ("_a", "_b")]
    g = d.groupBy(*by).agg(F.count("*").alias("n"), *((F.covar_pop(p, q) * F.count("*")).alias(f"{p}{q}") for p, q in pairs))
    c = {(p, q): F.col(f"{p}{q}") for p, q in pairs}
    det = c["_a", "_a"] * c["_b", "_b"] - c["_a", "_b"] * c["_a", "_b"]
    one = c["_y", "_y"] - F.try_divide(c["_a", "_y"] * c["_a", "_y"], c["_a", "_a"])
    b1 = F.try_divide(c["_a", "_y"] * c["_b", "_b"] - c["_b", "_y"] * c["_a", "_b"], det)
    b2 = F.try_divide(c["_b", "_y"] * c["_a", "_a"] - c["_a", "_y"] * c["_a", "_b"], det)
    both = c["_y", "_y"] - b1 * c["_a", "_y"] - b2 * c["_b", "_y"]
    return g.select(*by, "n", F.try_divide((one - both) * (F.col("n") - 3), both).alias("f"))


def var1(df: DataFrame, names: list[str], order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts c and matrix A of x_t = c + A x_(t-1) over one series of several columns, from one aggregate.

    A single series is one window; give long series a grid (`by` in the other operators) instead.
    """
    k, w = len(names), ordered([], order)
    d = df.select(*(F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(names)), *(F.lag(F.col(c).cast("double")).over(w).alias(f"x{i}") for i, c in enumerate(names))).dropna()
    m = d.agg(*(F.avg(f"{s}{i}") for s in "yx" for i in range(k)), *(F.covar_pop(f"{s}{i}", f"x{j}") for s in "yx" for i in range(k) for j in range(k))).first()
    if m[0] is None:
        return np.full(k, np.nan), np.full((k, k), np.nan)
    my, mx = np.array(m[:k], float), np.array(m[k : 2 * k], float)
    cy, cx = (np.array(m[2 * k + s * k * k : 2 * k + (s + 1) * k * k], float).reshape(k, k) for s in (0, 1))
    a = np.linalg.lstsq(cx, cy.T, rcond=None)[0].T
    return my - a @ mx, a


def impulse_response(a: np.ndarray, steps: int) -> list[np.ndarray]:
    return [np.linalg.matrix_power(a, h) for h in range(steps + 1)]


def garch_filter(df: DataFrame, value: str, by: list[str], order: list[str], key: list[str], omega: float, alpha: float, beta: float) -> DataFrame:
    """Conditional variance h_t = omega + alpha * e_(t-1)^2 + beta * h_(t-1), from the long-run variance; value is a return."""
    from fathom.operators.timeseries import carried

    need(omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 1, "omega > 0, alpha + beta < 1")

    def start():
        h, last = omega / (1 - alpha - beta), None

        def step(x: float) -> float:
            nonlocal h, last
            if last is not None:
                h = omega + alpha * last * last + beta * h
            last = x
            return h

        return step

    return carried(df, value, by, order, key, "h", start)


def fit_garch(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, omega, alpha, beta, log_likelihood) with the variance held to the sample's; a grid, then golden refinements."""
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def score(e2: np.ndarray, v: float, a: float, b: float) -> float:
        h, total = v, 0.0
        for x in e2:
            total -= 0.5 * (math.log(2 * math.pi * h) + x / h)
            h = v * (1 - a - b) + a * x + b * h
        return total

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")[value].dropna().astype(float).to_numpy()
        head = pdf[by].iloc[:1].reset_index(drop=True)
        if len(x) < 5 or x.var() == 0:
            return head.assign(omega=None, alpha=None, beta=None, log_likelihood=None)
        e2 = (x - x.mean()) ** 2
        v, a, b, step = float(e2.mean()), 0.1, 0.6, 0.2
        best = score(e2, v, a, b)
        while step > 0.005:
            moves = [(a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and a + i * step >= 0 and b + j * step >= 0 and a + b + (i + j) * step < 0.999]
            s, na, nb = max(((score(e2, v, p, q), p, q) for p, q in moves), default=(best, a, b))
            if s > best:
                best, a, b = s, na, nb
            else:
                step /= 2
        return head.assign(omega=v * (1 - a - b), alpha=a, beta=b, log_likelihood=best)

    return df.groupBy(*by).applyInPandas(run, f"{keys}, omega double, alpha double, beta double, log_likelihood double")


def kalman_smooth(df: DataFrame, value: str, by: list[str], order: list[str], q: float, r: float, key: list[str], p0: float = 1.0) -> DataFrame:
    """Smoothed level of a random walk seen through noise: the filter forwards, then the fixed-interval pass backwards."""
    from fathom.operators.timeseries import recursion

    def step(xs: list[float]) -> list[float]:
        level, p = [xs[0]], [p0]
        for z in xs[1:]:
            ahead = p[-1] + q
            gain = ahead / (ahead + r)
            level.append(level[-1] + gain * (z - level[-1]))
            p.append(ahead * (1 - gain))
        out = level[:]
        for k in range(len(xs) - 2, -1, -1):
            out[k] += p[k] / (p[k] + q) * (out[k + 1] - level[k])
        return out

    return recursion(df, value, by, order, key, "level", step)
