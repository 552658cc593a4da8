"""Queries of closed forms: counting, means, intervals, fractions, uncertain values, polynomials, rigid motions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import algebra, geometry, rigid
from fathom.functions.algebra import Interval, Polynomial, Rational, Uncertain

_L = ["l_orderkey", "l_linenumber"]


def _lines(s, d, **columns):
    return t(s, d, "lineitem").select(*_L, *(F.expr(e).alias(k) for k, e in columns.items()))


@query("""WITH x AS (SELECT event_id, event_id % 21 AS n, event_id % 5 AS k, 1 + event_id % 7 AS a, 2.0::DOUBLE + event_id % 3 AS b, 4.5::DOUBLE AS c, (event_id % 37) / 6.0 + 0.25 AS x FROM events)
SELECT event_id, (CASE WHEN n <= 20 THEN factorial(n::INTEGER) END)::BIGINT AS factorial, (CASE WHEN k > n THEN 0 ELSE factorial(n::INTEGER) / factorial((n - k)::INTEGER) END)::BIGINT AS permutations, (a + b + c) / 3 AS arithmetic,
    power(a * b * c, 1.0 / 3) AS geometric, 3 / (1.0 / a + 1 / b + 1 / c) AS harmonic, -b / a AS root, gamma(x) AS gamma FROM x""")
def counting_and_means(s, d):
    e = t(s, d, "events").select("event_id", (F.col("event_id") % 21).alias("n"), (F.col("event_id") % 5).alias("k"), (1 + F.col("event_id") % 7).cast("double").alias("a"), (2.0 + F.col("event_id") % 3).alias("b"), ((F.col("event_id") % 37) / 6.0 + 0.25).alias("x"))
    m = F.array("a", "b", F.lit(4.5))
    return e.select(
        "event_id", algebra.factorial(F.col("n")).alias("factorial"), algebra.permutations(F.col("n"), F.col("k")).alias("permutations"), algebra.arithmetic_mean(m).alias("arithmetic"), algebra.geometric_mean(m).alias("geometric"),
        algebra.harmonic_mean(m).alias("harmonic"), algebra.solve_linear(F.col("a"), F.col("b")).alias("root"), algebra.gamma(F.col("x")).alias("gamma"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_quantity + 3.0 + l_tax AS b, 20.0 + l_discount AS c, 30.0::DOUBLE AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, (a + b) / 2 AS midpoint, (b - a) / 2 AS radius, a <= 25 AND 25 <= b AS holds, CASE WHEN greatest(a, c) <= least(b, e) THEN greatest(a, c) END AS common_low, CASE WHEN greatest(a, c) <= least(b, e) THEN least(b, e) END AS common_high,
    least(a, c) AS hull_low, greatest(b, e) AS hull_high, sqrt(a) AS root_low, sqrt(b) AS root_high, a - e AS less_low, b - c AS less_high, a / e AS part_low, b / c AS part_high FROM x""")
def interval_columns(s, d):
    x = _lines(s, d, a="double(l_quantity)", b="l_quantity + 3.0D + l_tax", c="20.0D + l_discount", e="30.0D")
    p, q = Interval(F.col("a"), F.col("b")), Interval(F.col("c"), F.col("e"))
    parts = {"common": p.intersection(q), "hull": p.hull(q), "root": p.sqrt(), "less": p - q, "part": p / q}
    return x.select(*_L, p.midpoint().alias("midpoint"), p.radius().alias("radius"), p.contains(25.0).alias("holds"), *(c.alias(f"{k}_{n}") for k, v in parts.items() for n, c in (("low", v.low), ("high", v.high))))


@query("""WITH x AS (SELECT event_id, event_id % 12 + 1 AS a, event_id % 18 + 2 AS b, event_id % 7 - 3 AS c, event_id % 5 + 4 AS e FROM events)
SELECT event_id, (a // gcd(a, b))::BIGINT AS numer, (b // gcd(a, b))::BIGINT AS denom, (a * e + c * b)::DOUBLE / (b * e) AS total, ((a * e + c * b) // gcd(a * e + c * b, b * e))::BIGINT AS total_numer, ((a * c) // gcd(a * c, b * e))::BIGINT AS product_numer, ((b * e) // gcd(a * c, b * e))::BIGINT AS product_denom,
    CASE WHEN c <> 0 THEN ((a * e) // gcd(a * e, b * c) * sign(c))::BIGINT END AS quotient_numer, CASE WHEN c <> 0 THEN ((b * abs(c)) // gcd(a * e, b * c))::BIGINT END AS quotient_denom, power(b // gcd(a, b), 3)::BIGINT AS cube_denom FROM x""")
def rational_columns(s, d):
    e = t(s, d, "events").select("event_id", *(F.expr(x).alias(k) for k, x in (("a", "event_id % 12 + 1"), ("b", "event_id % 18 + 2"), ("c", "event_id % 7 - 3"), ("e", "event_id % 5 + 4"))))
    p, q = Rational.of(F.col("a"), F.col("b")), Rational.of(F.col("c"), F.col("e"))
    total, product, quotient = p + q, p * q, p / q
    return e.select(
        "event_id", p.numer.alias("numer"), p.denom.alias("denom"), total.value().alias("total"), total.numer.alias("total_numer"), product.numer.alias("product_numer"), product.denom.alias("product_denom"),
        quotient.numer.alias("quotient_numer"), quotient.denom.alias("quotient_denom"), p.power(3).denom.alias("cube_denom"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS v, 0.1 + l_tax AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, u / v AS relative, power(v, 1.5) AS power, 1.5 * sqrt(v) * u AS power_sd, sqrt(v) AS root, u / (2 * sqrt(v)) AS root_sd, exp(v / 10) AS exp, exp(v / 10) * u / 10 AS exp_sd, ln(v) AS ln, u / v AS ln_sd,
    sin(v) AS sin, abs(cos(v)) * u AS sin_sd, cos(v) AS cos, abs(sin(v)) * u AS cos_sd FROM x""")
def uncertain_functions(s, d):
    x = _lines(s, d, v="double(l_quantity)", u="0.1D + l_tax")
    q = Uncertain(F.col("v"), F.col("u"))
    tenth = Uncertain(F.col("v") / 10, F.col("u") / 10)
    made = {"power": q.power(1.5), "root": q.sqrt(), "exp": tenth.exp(), "ln": q.ln(), "sin": q.sin(), "cos": q.cos()}
    return x.select(*_L, q.relative().alias("relative"), *(c.alias(n) for k, m in made.items() for n, c in ((k, m.value), (f"{k}_sd", m.sd))))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_discount AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, a + 3 + 2 * x + 4 * x * x AS sum, (a + 2 * x) * (3 + 4 * x * x) AS product, 8.0::DOUBLE AS leading, 2 + 8 * x AS slope, a * x + x * x AS area, -4 * a / 4 + 0 * x AS unused, 2 * x - a AS quotient, 3 + a * a AS rest FROM x""".replace("-4 * a / 4 + 0 * x AS unused, ", ""))
def polynomial_columns(s, d):
    x, a = F.col("x"), F.col("a")
    p, q = Polynomial((a, 2.0)), Polynomial((3.0, 0.0, 4.0))
    quotient, rest = q.divide(p)
    return _lines(s, d, a="double(l_quantity)", x="l_discount").select(
        *_L, (p + q).value(x).alias("sum"), (p * q).value(x).alias("product"), (p * q).leading().alias("leading"), (p + q).derivative().value(x).alias("slope"), p.integral().value(x).alias("area"), quotient.value(x).alias("quotient"), rest.value(x).alias("rest"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(x, 0) AS relu, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relu_slope, CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS leaky, CASE WHEN x > 0 THEN 1 ELSE 0.01 END::DOUBLE AS leaky_slope, 1 / (1 + exp(-x)) AS sigmoid,
    exp(-x) / power(1 + exp(-x), 2) AS sigmoid_slope, (exp(x) - exp(-x)) / (exp(x) + exp(-x)) AS tanh, 4 / power(exp(x) + exp(-x), 2) AS tanh_slope FROM x""")
def activation_columns(s, d):
    x = F.col("x")
    names = ("relu", "leaky", "sigmoid", "tanh")
    return _lines(s, d, x="(l_quantity - 25) / 10").select(*_L, *(c.alias(n) for k in names for n, c in ((k, algebra.activation(k, x)), (f"{k}_slope", algebra.activation_slope(k, x)))))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, l_tax * 10 AS y, (l_quantity - 25) / 10 AS z, l_quantity::DOUBLE AS p FROM lineitem),
r AS (SELECT *, cos(y) * cos(z) * p + (sin(x) * sin(y) * cos(z) - cos(x) * sin(z)) * 2 + (cos(x) * sin(y) * cos(z) + sin(x) * sin(z)) * 3 AS px, cos(y) * sin(z) * p + (sin(x) * sin(y) * sin(z) + cos(x) * cos(z)) * 2 + (cos(x) * sin(y) * sin(z) - sin(x) * cos(z)) * 3 AS py,
    -sin(y) * p + sin(x) * cos(y) * 2 + cos(x) * cos(y) * 3 AS pz FROM x)
SELECT l_orderkey, l_linenumber, x AS euler_x, y AS euler_y, z AS euler_z, px AS turned_x, py AS turned_y, pz AS turned_z, px + 1 AS moved_x, py - 2 AS moved_y, pz + p AS moved_z, p AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z,
    1.0::DOUBLE AS shift_x, -2.0::DOUBLE AS shift_y, p AS shift_z, 1.0::DOUBLE AS same, 2 * px + 1 AS grown_x FROM r""")
def rigid_motions(s, d):
    """Euler angles through quaternions and matrices and back; isometries, dual quaternions and similarities of points."""
    x = _lines(s, d, x="l_discount * 10", y="l_tax * 10", z="(l_quantity - 25) / 10", p="double(l_quantity)")
    p, q = (F.col("p"), F.lit(2.0), F.lit(3.0)), rigid.from_euler(F.col("x"), F.col("y"), F.col("z"))
    x = x.select(*_L, "p", *(c.alias(f"q{k}") for k, c in enumerate(q)))
    q = tuple(F.col(f"q{k}") for k in range(4))
    x = x.select("*", *(c.alias(f"r{k}") for k, c in enumerate(rigid.from_matrix(geometry.q_matrix(q)))))
    again = tuple(F.col(f"r{k}") for k in range(4))
    m = rigid.Isometry(q, (F.lit(1.0), F.lit(-2.0), F.col("p")))
    dual = rigid.DualQuaternion.of(m)
    vectors = {"euler": rigid.to_euler(q), "turned": rigid.rotate(again, p), "moved": rigid.apply(m.matrix(), p), "back": m.inverse()(dual.isometry()(p)), "shift": dual.translation()}
    same = geometry.dot(q, again)
    return x.select(*_L, *(c.alias(f"{k}_{n}") for k, v in vectors.items() for n, c in zip("xyz", v, strict=True)), F.abs(same).alias("same"), rigid.apply(m.matrix(2.0), p)[0].alias("grown_x"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS x, l_tax * 10 AS y, -(2 + l_quantity) AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, x / tan({math.pi / 6}) / 1.5 / -z AS seen_x, y / tan({math.pi / 6}) / -z AS seen_y, (z * 101.0 / -99.0 + 200.0 / -99.0) / -z AS depth, (x + 1) * 2 / 4 - 1 AS flat_x, (-z - 1) * 2 / 99.0 - 1 AS flat_depth,
    y - 2 AS eye_x, z - 3 AS eye_y, x - 1 AS eye_z, 2 * x + 5 AS grown_x, acos(least(1, greatest(-1, 0.5))) AS turn, 1 / sqrt(3.0) AS axis_x FROM x""")
def projections(s, d):
    p = (F.col("x"), F.col("y"), F.col("z"))
    x = _lines(s, d, x="l_discount * 20 - 1", y="l_tax * 10", z="-(2 + l_quantity)")
    lit = lambda *v: tuple(F.lit(float(k)) for k in v)
    seen, flat = rigid.apply(rigid.perspective(F.lit(math.pi / 3), 1.5, 1, 100), p), rigid.apply(rigid.orthographic(-1, 3, -1, 1, 1, 100), p)
    eye = rigid.apply(rigid.look_at(lit(1, 2, 3), lit(0, 2, 3), lit(0, 0, 1)), p)
    grown = rigid.apply(rigid.product(rigid.translation(lit(5, 0, 0)), rigid.scaling(lit(2, 2, 2))), p)
    q = geometry.q_axis_angle(lit(1, 1, 1), F.lit(math.pi / 3))
    return x.select(
        *_L, seen[0].alias("seen_x"), seen[1].alias("seen_y"), seen[2].alias("depth"), flat[0].alias("flat_x"), flat[2].alias("flat_depth"), *(c.alias(f"eye_{n}") for n, c in zip("xyz", eye, strict=True)), grown[0].alias("grown_x"),
        rigid.angle(q).alias("turn"), rigid.axis(q)[0].alias("axis_x"),
    )
