"""Queries of derivatives of several kinds, with derivatives by hand in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import complexes, reverse, symbolic
from fathom.functions.symbolic import Dual, Symbol, call

_L = ["l_orderkey", "l_linenumber"]
_XYZ = "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_discount * 5 + 0.1 AS y, l_tax * 5 + 0.2 AS z FROM lineitem)"


def _xyz(s, d):
    return t(s, d, "lineitem").select(*_L, (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 5 + 0.1).alias("y"), (F.col("l_tax") * 5 + 0.2).alias("z"))


@query(f"""{_XYZ} SELECT l_orderkey, l_linenumber, 2 * y + exp(x) AS h_xx, 2 * x + cos(z) AS h_xy, -sin(z) * y AS h_xz, 0.0::DOUBLE AS h_yy, -x * sin(z) AS h_yz, -x * y * cos(z) AS h_zz, 2 * y + exp(x) - x * y * cos(z) AS laplacian,
    2 * x + x + cos(z) AS divergence, -y * sin(z) * 0 - x AS curl_x, y AS curl_y, y AS curl_z, -y AS curl_plane, sqrt(power(2 * x * y + y * cos(z) + exp(x), 2) + power(x * x + x * cos(z), 2) + power(x * y * sin(z), 2)) AS slope_norm,
    (2 * x * y + y * cos(z) + exp(x)) + 2 * (x * x + x * cos(z)) - 3 * (-x * y * sin(z)) AS directional, 2 * (2 * x) + 3 * y AS pulled_x, 3 * x AS pulled_y, true AS close FROM x""")
def vector_calculus(s, d):
    """Second derivatives, divergence, curl, and products with directions, of x^2 y + x y cos z + e^x and of fields."""
    x, y, z = map(Symbol, "xyz")
    names = ["x", "y", "z"]
    e = x**2 * y + x * y * call("cos", z) + call("exp", x)
    h = symbolic.hessian(e, names)
    field, plane = [x**2, x * y, call("sin", z) + x * 0], [y**2, x**2 * 0 + x * y + x * 0]
    turn = symbolic.curl([x**2, x * y, x * 0 - x * y], names)
    pulled = symbolic.pulled_back([x**2, x * y], ["x", "y"], [2.0, 3.0])
    return _xyz(s, d).select(
        *_L, *(h[i][j].alias(f"h_{names[i]}{names[j]}") for i in range(3) for j in range(i, 3)), symbolic.laplacian(e, names).alias("laplacian"), symbolic.divergence(field, names).alias("divergence"),
        *(c.alias(f"curl_{n}") for c, n in zip(turn, names, strict=True)), symbolic.curl(plane, ["x", "y"])[0].alias("curl_plane"), symbolic.gradient_norm(e, names).alias("slope_norm"), symbolic.directional(e, names, [1.0, 2.0, -3.0]).alias("directional"),
        pulled[0].alias("pulled_x"), pulled[1].alias("pulled_y"), (symbolic.gradient_error(e, names) < 1e-6).alias("close"),
    )


@query(f"""{_XYZ}, w AS (SELECT *, 1 / (1 + exp(-x * y)) AS s FROM x)
SELECT l_orderkey, l_linenumber, s * z + x / y AS value, s * (1 - s) * y * z + 1 / y AS by_x, s * (1 - s) * x * z - x / (y * y) AS by_y, s AS by_z, s * (1 - s) * (1 - 2 * s) * y * y * z AS by_xx,
    s * (1 - s) * z + s * (1 - s) * (1 - 2 * s) * x * y * z - 1 / (y * y) AS by_xy, 2 * x * y AS j00, x * x AS j01, CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS j10, 0.0::DOUBLE AS j11 FROM w""")
def reverse_derivatives(s, d):
    """One pass back over sigmoid(x y) z + x / y; second derivatives; a jacobian with a kink."""
    f = lambda x, y, z: (x * y).sigmoid() * z + x / y
    c = [F.col(k) for k in "xyz"]
    tape = reverse.Tape()
    g, h = reverse.gradient(f, *c), reverse.hessian(f, *c)
    j = reverse.jacobian(lambda x, y: [x * x * y, (x - 0.5).relu()], *c[:2])
    return _xyz(s, d).select(*_L, f(*map(tape.var, c)).value.alias("value"), *(v.alias(f"by_{k}") for v, k in zip(g, "xyz", strict=True)), h[0][0].alias("by_xx"), h[0][1].alias("by_xy"), *(j[a][b].alias(f"j{a}{b}") for a in (0, 1) for b in (0, 1)))


_SLOPES = {"sin": "cos(x)", "cos": "-sin(x)", "tan": "1 + power(tan(x), 2)", "exp": "exp(x)", "log": "1 / x", "sqrt": "1 / (2 * sqrt(x))", "tanh": "4 / power(exp(x) + exp(-x), 2)", "sinh": "(exp(x) + exp(-x)) / 2",
           "cosh": "(exp(x) - exp(-x)) / 2", "atan": "1 / (1 + x * x)", "asin": "1 / sqrt(1 - x * x)", "acos": "-1 / sqrt(1 - x * x)", "abs": "1.0::DOUBLE"}


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 52 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS {k}_forward, {v} AS {k}_reverse' for k, v in _SLOPES.items())} FROM x")
def elementary_slopes(s, d):
    """Slopes of the elementary functions, forward and in reverse."""
    x = F.col("x")
    both = {k: (Dual.variable(x).apply(k).slope, reverse.gradient(lambda v, k=k: v.apply(k), x)[0]) for k in _SLOPES}
    return t(s, d, "lineitem").select(*_L, (F.col("l_quantity") / 52).alias("x")).select(*_L, *(c.alias(f"{k}_{n}") for k, v in both.items() for n, c in zip(("forward", "reverse"), v, strict=True)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 20 AS a, l_discount * 10 + 0.25 AS b FROM lineitem), s AS (SELECT *, a * a - b * b AS qa, 2 * a * b AS qb FROM x)
SELECT l_orderkey, l_linenumber, a AS asin_re, b AS asin_im, a AS acos_re, b AS acos_im, a AS atan_re, b AS atan_im, a AS asinh_re, b AS asinh_im, a AS acosh_re, b AS acosh_im, -a AS root0_re, -b AS root0_im, 0.0::DOUBLE AS root1_re, 0.0::DOUBLE AS root1_im,
    2 * a + 2 AS slope_re, 2 * b AS slope_im, ((a - 0.5) * (1 - 0.5 * a) - 0.5 * b * b) / (power(1 - 0.5 * a, 2) + 0.25 * b * b) AS blaschke_re FROM s""")
def complex_inverses(s, d):
    """sin(asin z) and the like are z; roots of z^2 + w z; the slope of a polynomial; a Blaschke factor."""
    C = complexes
    x = t(s, d, "lineitem").select(*_L, ((F.col("l_quantity") - 25) / 20).alias("a"), (F.col("l_discount") * 10 + 0.25).alias("b"))
    z, zero, one = (F.col("a"), F.col("b")), (F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0))
    inverse = {"asin": C.sin(C.asin(z)), "acos": C.cos(C.acos(z)), "atan": C.tan(C.atan(z)), "asinh": C.sinh(C.asinh(z)), "acosh": C.cosh(C.acosh(z))}
    roots = C.quadratic_roots(one, z, zero)
    first = C.modulus(roots[0]) >= C.modulus(roots[1])
    parts = {**inverse, "root0": tuple(F.when(first, p).otherwise(q) for p, q in zip(*roots, strict=True)), "root1": tuple(F.round(F.when(first, q).otherwise(p), 9) + 0.0 for p, q in zip(*roots, strict=True)), "slope": C.polynomial(z, C.polynomial_slope([3, 2, 1]))}
    return x.select(*_L, *(c.alias(f"{k}_{n}") for k, v in parts.items() for n, c in zip(("re", "im"), C.settled(v), strict=True)), C.blaschke(z, [0.5])[0].alias("blaschke_re"))
