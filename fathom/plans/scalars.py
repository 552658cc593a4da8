"""Queries of the column functions, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import complexes, distributions, geometry, symbolic, units


@query("""WITH x AS (SELECT event_id, value / 50 AS x, value / 1000 AS u, (event_id % 12)::DOUBLE AS k FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN x > 0 THEN exp(1.5 * ln(x) - x - lgamma(2.5)) ELSE 0 END AS gamma, exp(lgamma(4) - lgamma(3.5) - 0.5 * ln(7 * pi()) - 4 * ln(1 + x * x / 7)) AS student,
    CASE WHEN x > 0 THEN exp(-ln(x) * ln(x) / 2) / (x * sqrt(2 * pi())) ELSE 0 END AS lognormal, 1 / (pi() * (1 + x * x)) AS cauchy, exp(-abs(x)) / 2 AS laplace,
    CASE WHEN x > 0 THEN exp(2 * ln(4.0 / 9) + ln(x) - 6.5 * ln(1 + 4.0 / 9 * x) - lgamma(2) - lgamma(4.5) + lgamma(6.5)) ELSE 0 END AS f, CASE WHEN x > 0 THEN sqrt(3 / (2 * pi() * x * x * x)) * exp(-3 * (x - 2) * (x - 2) / (8 * x)) ELSE 0 END AS wald,
    CASE WHEN 1 + 0.2 * (x - 1) > 0 THEN exp(-pow(1 + 0.2 * (x - 1), -5)) ELSE 0 END AS gev, CASE WHEN x <= 0 THEN 0 WHEN x < 1 THEN x * x / 4 WHEN x < 4 THEN 1 - (4 - x) * (4 - x) / 12 ELSE 1 END AS triangular,
    exp(lgamma(13) - lgamma(k + 1) - lgamma(13 - k) + k * ln(0.3) + (12 - k) * ln(0.7)) AS binomial, exp(lgamma(k + 4) - lgamma(k + 1) - lgamma(4) + 4 * ln(0.4) + k * ln(0.6)) AS negative_binomial,
    CASE WHEN k >= 1 THEN pow(k, -1.5) / (SELECT sum(pow(i, -1.5)) FROM range(1, 21) r(i)) ELSE 0 END AS zipf FROM x""")
def density_columns(s, d):
    x, k = F.col("x"), F.col("k")
    e = t(s, d, "events").where("value IS NOT NULL").select("event_id", (F.col("value") / 50).alias("x"), (F.col("event_id") % 12).cast("double").alias("k"))
    return e.select(
        "event_id", distributions.gamma_pdf(x, 2.5).alias("gamma"), distributions.student_t_pdf(x, 7).alias("student"), distributions.lognormal_pdf(x).alias("lognormal"), distributions.cauchy_pdf(x).alias("cauchy"),
        distributions.laplace_pdf(x).alias("laplace"), distributions.f_pdf(x, 4, 9).alias("f"), distributions.wald_pdf(x, 2.0, 3.0).alias("wald"), distributions.gev_cdf(x, 1.0, 1.0, 0.2).alias("gev"),
        distributions.triangular_cdf(x, 0.0, 1.0, 4.0).alias("triangular"), distributions.binomial_pmf(k, 12, 0.3).alias("binomial"), distributions.neg_binomial_pmf(k, 4, 0.4).alias("negative_binomial"), distributions.zipf_pmf(k, 1.5, 20).alias("zipf"),
    )


@query("""WITH x AS (SELECT event_id, (event_id % 997 + 0.5) / 997 AS p FROM events)
SELECT event_id, tan(pi() * (p - 0.5)) AS cauchy, exp(-ln(1 - p) / 2) AS pareto, -sign(p - 0.5) * ln(1 - 2 * abs(p - 0.5)) AS laplace, ln(p) - ln(1 - p) AS logistic, -ln(-ln(p)) AS gumbel, sqrt(-2 * ln(1 - p)) AS rayleigh,
    CASE WHEN p < 0.25 THEN sqrt(4 * p) ELSE 4 - sqrt((1 - p) * 12) END AS triangular FROM x""")
def quantile_columns(s, d):
    p = F.col("p")
    return t(s, d, "events").select("event_id", ((F.col("event_id") % 997 + 0.5) / 997).alias("p")).select(
        "event_id", distributions.cauchy_quantile(p).alias("cauchy"), distributions.pareto_quantile(p, 2).alias("pareto"), distributions.laplace_quantile(p).alias("laplace"), distributions.logistic_quantile(p).alias("logistic"),
        distributions.gumbel_quantile(p).alias("gumbel"), distributions.rayleigh_quantile(p).alias("rayleigh"), distributions.triangular_quantile(p, 0.0, 1.0, 4.0).alias("triangular"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 10 + 0.5 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, exp(a) * cos(b) AS exp_re, exp(a) * sin(b) AS exp_im, ln(sqrt(a * a + b * b)) AS log_re, atan2(b, a) AS log_im, sin(a) * (exp(b) + exp(-b)) / 2 AS sin_re, cos(a) * (exp(b) - exp(-b)) / 2 AS sin_im,
    a + a / (a * a + b * b) AS map_re, b - b / (a * a + b * b) AS map_im, a * a - b * b + 2 * a + 3 AS poly_re, 2 * a * b + 2 * b AS poly_im FROM x""")
def complex_functions(s, d):
    z = (F.col("a"), F.col("b"))
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10 + 0.5).alias("b"))
    parts = {"exp": complexes.exp(z), "log": complexes.log(z), "sin": complexes.sin(z), "map": complexes.joukowski(z), "poly": complexes.polynomial(z, [3, 2, 1])}
    return x.select("l_orderkey", "l_linenumber", *(c.alias(f"{n}_{k}") for n, pair in parts.items() for c, k in zip(pair, ("re", "im"), strict=True)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem), u AS (SELECT *, least(greatest((x * 30 + y * 8) / 964, 0), 1) AS u FROM x)
SELECT l_orderkey, l_linenumber, sqrt((x - 30 * u) * (x - 30 * u) + (y - 8 * u) * (y - 8 * u)) AS to_segment, (x + 2 * y - 2 * z - 5) / 3 AS to_plane, x * x + y * y + z * z <= 900 AS in_ball,
    x BETWEEN 5 AND 40 AND y BETWEEN 2 AND 9 AND z BETWEEN 0 AND 6 AS in_box, z BETWEEN 0 AND 6 AND x * x + y * y <= 400 AS in_cylinder, y * 3 - z * 2 AS cross_x, z * 1 - x * 3 AS cross_y, x * 2 - y * 1 AS cross_z FROM u""")
def geometry_columns(s, d):
    lit = lambda *v: tuple(F.lit(float(k)) for k in v)
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    p = (F.col("x"), F.col("y"), F.col("z"))
    c = geometry.cross(p, lit(1, 2, 3))
    return x.select(
        "l_orderkey", "l_linenumber", geometry.segment_distance(p[:2], lit(0, 0), lit(30, 8)).alias("to_segment"), geometry.plane_distance(p, lit(5, 0, 0), lit(1, 2, -2)).alias("to_plane"), geometry.in_ball(p, lit(0, 0, 0), 30.0).alias("in_ball"),
        geometry.in_box(p, lit(5, 2, 0), lit(40, 9, 6)).alias("in_box"), geometry.in_cylinder(p, lit(0, 0, 0), lit(0, 0, 1), 20.0, 6.0).alias("in_cylinder"), c[0].alias("cross_x"), c[1].alias("cross_y"), c[2].alias("cross_z"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_quantity * l_discount + sin(l_tax * l_quantity) AS value, 2 * l_quantity * l_discount + l_tax * cos(l_tax * l_quantity) AS by_quantity, l_quantity * l_quantity AS by_discount, l_quantity * cos(l_tax * l_quantity) AS by_tax FROM lineitem")
def symbolic_gradient(s, d):
    q, c, x = (symbolic.Symbol(n) for n in ("l_quantity", "l_discount", "l_tax"))
    e = q**2 * c + symbolic.call("sin", x * q)
    g = symbolic.gradient(e, ["l_quantity", "l_discount", "l_tax"])
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", symbolic.column(e).alias("value"), g[0].alias("by_quantity"), g[1].alias("by_discount"), g[2].alias("by_tax"))


@query("SELECT l_orderkey, l_linenumber, exp(l_discount) / l_quantity AS value, exp(l_discount) * (l_quantity * 0.5 - 1) / (l_quantity * l_quantity) AS slope FROM lineitem")
def dual_derivative(s, d):
    """Slope along the direction in which quantity grows by 1 and discount by 0.5."""
    y = symbolic.Dual(F.col("l_discount"), 0.5).apply("exp") / symbolic.Dual.variable(F.col("l_quantity"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", y.value.alias("value"), y.slope.alias("slope"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 1000 / (3600 * (l_tax + 1)) AS metres_a_second, l_extendedprice * 0.001 * (l_quantity * 1000 / (3600 * (l_tax + 1))) * (l_quantity * 1000 / (3600 * (l_tax + 1))) / 2 AS joules FROM lineitem")
def quantity_columns(s, d):
    v = units.quantity(F.col("l_quantity"), "km") / units.quantity(F.col("l_tax") + 1, "h")
    e = units.quantity(F.col("l_extendedprice"), "g") * v**2 * 0.5
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", v.to("m/s").alias("metres_a_second"), e.to("J").alias("joules"))
