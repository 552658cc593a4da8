"""Queries of quantiles, intervals and random columns, with closed forms in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import quantiles as Q
from fathom.functions.samplers import Sampler, halton, sobol_2
from fathom.session import spread


@query("""WITH x AS (SELECT event_id, (event_id % 997 + 0.5) / 997 AS p FROM events)
SELECT event_id, -ln(1 - p) / 2 AS gamma, -2 * ln(1 - p) AS chi_square, sqrt(p) AS beta, 1 - power(1 - p, 1.0 / 3) AS beta_turned, tan(pi() * (p - 0.5)) AS t1, (2 * p - 1) / sqrt(2 * p * (1 - p)) AS t2, 3 * (power(1 - p, -2.0 / 3) - 1) / 2 AS f23,
    p AS normal, p AS lognormal, p AS truncated, p AS gamma_back, p AS t_back, 1 - exp(-p * p / 2) AS chi2, 3.0::DOUBLE AS pareto_mean, p * 0.25 AS copula FROM x""")
def inverse_distributions(s, d):
    """Quantiles with a closed form, and ways there and back for the others; a copula of independent parts."""
    p, c = F.col("p"), Q.column
    e = spread(t(s, d, "events").select("event_id", ((F.col("event_id") % 997 + 0.5) / 997).alias("p")), "event_id")
    return e.select(
        "event_id", c(Q.gamma_quantile, p, 1, 2).alias("gamma"), c(Q.chi_square_quantile, p, 2).alias("chi_square"), c(Q.beta_quantile, p, 2, 1).alias("beta"), c(Q.beta_quantile, p, 1, 3).alias("beta_turned"),
        c(Q.t_quantile, p, 1).alias("t1"), c(Q.t_quantile, p, 2).alias("t2"), c(Q.f_quantile, p, 2, 3).alias("f23"), c(lambda x: Q.normal_cdf(Q.normal_quantile(x)), p).alias("normal"),
        c(lambda x: Q.normal_cdf((np.log(Q.lognormal_quantile(x, 1.0, 0.5)) - 1) / 0.5), p).alias("lognormal"), c(lambda x: Q.truncated_normal_cdf(Q.truncated_normal_quantile(x, 1.0, 2.0, -1.0, 2.5), 1.0, 2.0, -1.0, 2.5), p).alias("truncated"),
        c(lambda x: Q.gamma_p(3.7, Q.gamma_quantile(x, 3.7)), p).alias("gamma_back"), c(lambda x: Q.t_cdf(Q.t_quantile(x, 7.5), 7.5), p).alias("t_back"), c(Q.chi_cdf, p, 2).alias("chi2"), c(Q.pareto_mean, F.lit(1.5)).alias("pareto_mean"),
        c(lambda u, v: Q.gaussian_copula_cdf(u, v, 0.0), p, F.lit(0.25)).alias("copula"),
    )


_T2 = "(2 * 0.975 - 1) / sqrt(2 * 0.975 * 0.025)"


@query(f"""WITH g AS (SELECT l_orderkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1 HAVING count(*) = 3)
SELECT l_orderkey, m - {_T2} * s / sqrt(3) AS low, m + {_T2} * s / sqrt(3) AS high, m - 1.959963984540054 * 100 / sqrt(3) AS known_low, m + 1.959963984540054 * 100 / sqrt(3) AS known_high FROM g""")
def mean_intervals(s, d):
    """Confidence intervals of means of orders with three lines: deviation from the sample, and known to be 100."""
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s"), F.count("*").alias("n")).where("n = 3")
    q, z = Q.column(Q.t_quantile, F.lit(0.975), F.col("n") - 1.0), Q.column(Q.normal_quantile, F.lit(0.975))
    root = F.sqrt("n")
    return g.select("l_orderkey", (F.col("m") - q * F.col("s") / root).alias("low"), (F.col("m") + q * F.col("s") / root).alias("high"), (F.col("m") - z * 100 / root).alias("known_low"), (F.col("m") + z * 100 / root).alias("known_high"))


_MOMENTS = {"uniform": (0.5, 1 / 12), "normal": (1.0, 4.0), "exponential": (0.5, 0.25), "gamma": (1.5, 0.75), "beta": (0.4, 0.04), "poisson": (3.0, 3.0), "binomial": (2.4, 1.68), "geometric": (3.0, 12.0), "laplace": (0.0, 2.0), "logistic": (0.0, 3.2899),
            "weibull": (0.8862, 0.2146), "chi_squared": (3.0, 6.0), "integer": (4.5, 8.25), "boolean": (0.3, 0.21), "sphere": (0.0, 1 / 3), "disk": (0.0, 0.25), "choice": (1.25, 0.6875), "lognormal": (1.0317, 0.0687), "pareto": (1.25, 0.1042), "student": (0.0, 1.25)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, true)" for k in _MOMENTS) + ") v(name, mean_fits, variance_fits)")
def sampler_moments(s, d):
    """Draws for every event have the mean and variance of their distribution, within five standard errors and a tenth."""
    r = Sampler(F.col("event_id"), seed=5)
    draws = {
        "uniform": r.uniform(), "normal": r.normal(1.0, 2.0), "exponential": r.exponential(2.0), "gamma": r.gamma(3.0, 2.0), "beta": r.beta(2.0, 3.0), "poisson": r.poisson(3.0), "binomial": r.binomial(8, 0.3), "geometric": r.geometric(0.25), "laplace": r.laplace(),
        "logistic": r.logistic(), "weibull": r.weibull(2.0), "chi_squared": r.chi_squared(3.0), "integer": r.integer(0, 10), "boolean": r.boolean(0.3).cast("int"), "sphere": r.on_sphere()[0], "disk": r.in_disk()[0], "choice": r.choice([1.0, 1.0, 2.0]),
        "lognormal": r.lognormal(0.0, 0.25), "pareto": r.pareto(5.0), "student": r.student_t(10.0),
    }
    x = spread(t(s, d, "events").select("event_id"), "event_id").select(*(c.cast("double").alias(k) for k, c in draws.items()))
    x = x.agg(*(a(k).alias(f"{k}{i}") for k in draws for i, a in enumerate((F.avg, F.var_samp))), F.count("*").alias("n"))
    fits = lambda k: F.struct(F.lit(k).alias("name"), (F.abs(F.col(f"{k}0") - _MOMENTS[k][0]) < 5 * F.sqrt(F.lit(_MOMENTS[k][1])) / F.sqrt("n") + 1e-4).alias("mean_fits"), (F.abs(F.col(f"{k}1") / _MOMENTS[k][1] - 1) < 0.1).alias("variance_fits"))
    return x.select(F.explode(F.array(*map(fits, draws))).alias("v")).select("v.*")


@query("""WITH RECURSIVE r AS (SELECT event_id, event_id % 5000 + 1 AS n, 0.0::DOUBLE AS x, 1.0::DOUBLE AS f, event_id % 5000 + 1 AS m, 0.0::DOUBLE AS y, 1.0::DOUBLE AS g FROM events
    UNION ALL SELECT event_id, n // 2, x + (n % 2) * f / 2, f / 2, m // 3, y + (m % 3) * g / 3, g / 3 FROM r WHERE n > 0 OR m > 0)
SELECT event_id, max(x) AS halton2, max(y) AS halton3, max(x) AS sobol0 FROM r GROUP BY event_id""")
def low_discrepancy(s, d):
    i = F.col("event_id") % 5000 + 1
    return t(s, d, "events").select("event_id", halton(i, 2).alias("halton2"), halton(i, 3).alias("halton3"), sobol_2(i)[0].alias("sobol0"))
