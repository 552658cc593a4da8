import math

import pytest
from pyspark.sql import functions as F

from fathom.errors import FathomError
from fathom.functions import complexes, distributions, geometry, symbolic, units
from fathom.functions.symbolic import Symbol, call, differentiate, evaluate, simplify, substitute


def one(spark, *cols):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first())


def test_gamma_and_masses(spark):
    got = one(spark, *(distributions.ln_gamma(x) for x in (0.1, 0.5, 3, 50.5, 1000)))
    assert got == pytest.approx([math.lgamma(x) for x in (0.1, 0.5, 3, 50.5, 1000)], abs=1e-9)
    sums = spark.range(0, 13).select(F.col("id").cast("double").alias("k")).agg(
        F.sum(distributions.binomial_pmf(F.col("k"), 12, 0.3)), F.sum(distributions.beta_binomial_pmf(F.col("k"), 12, 2, 3)), F.sum(distributions.hypergeometric_pmf(F.col("k"), 30, 12, 12)), F.sum(distributions.zipf_pmf(F.col("k"), 1.2, 12))
    ).first()
    assert list(sums) == pytest.approx([1, 1, 1, 1], abs=1e-9)


def test_densities_integrate_to_one_and_have_edges(spark):
    x = F.col("x")
    fs = [distributions.gamma_pdf(x, 2.5), distributions.f_pdf(x, 4, 9), distributions.wald_pdf(x, 2.0, 3.0), distributions.chi_pdf(x, 3), distributions.maxwell_pdf(x, 1.5), distributions.gumbel_pdf(x), distributions.gev_pdf(x, 0.0, 1.0, -0.2), distributions.triangular_pdf(x, 0.0, 0.0, 2.0), distributions.gpd_pdf(x, 0.0, 1.0, -0.3), distributions.mixture_pdf(x, [(0.3, 0, 1), (0.7, 4, 2)])]
    grid = spark.range(-20_000, 60_000).select(((F.col("id") + 0.5) / 1000).alias("x"))
    assert list(grid.agg(*(F.sum(f) / 1000 for f in fs)).first()) == pytest.approx([1] * len(fs), abs=2e-3)
    assert one(spark, distributions.gamma_pdf(F.lit(-1.0), 2), distributions.uniform_cdf(F.lit(3.0)), distributions.lognormal_pdf(F.lit(None).cast("double"))) == [0.0, 1.0, None]


def test_array_laws(spark):
    m, dl, n = one(spark, distributions.multinomial_pmf(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.25), F.lit(0.75))), distributions.dirichlet_log_pdf(F.array(F.lit(0.2), F.lit(0.8)), [2.0, 3.0]), distributions.mvnormal_log_pdf([F.lit(0.0), F.lit(0.0)], [0, 0], [[2, 0], [0, 2]]))
    assert m == pytest.approx(3 * 0.25 * 0.75**2) and dl == pytest.approx(math.log(12 * 0.2 * 0.64)) and n == pytest.approx(-math.log(4 * math.pi))


def test_complex(spark):
    z = (F.lit(1.0), F.lit(2.0))
    root, tan, mob = complexes.sqrt(z), complexes.tan(z), complexes.mobius(z, 1, 1j, 2, 3)
    import cmath

    assert complex(*one(spark, *root)) == pytest.approx(cmath.sqrt(1 + 2j)) and complex(*one(spark, *tan)) == pytest.approx(cmath.tan(1 + 2j)) and complex(*one(spark, *mob)) == pytest.approx((1 + 2j + 1j) / (2 * (1 + 2j) + 3))


def test_geometry(spark):
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    cross, touch, apart = (geometry.segments_cross(p(0, 0), p(2, 2), a, b) for a, b in ((p(0, 2), p(2, 0)), (p(1, 1), p(3, 3)), (p(3, 0), p(4, 1))))
    assert one(spark, cross, touch, apart, geometry.segment_distance(p(3, 4), p(0, 0), p(0, 0)), geometry.ray_plane(p(0, 0, 1), p(0, 0, 1), p(0, 0, 0), p(0, 0, 1))) == [True, True, False, 5.0, None]
    q = geometry.q_axis_angle(p(0, 0, 2), F.lit(math.pi / 2))
    half = geometry.q_slerp(p(1, 0, 0, 0), q, F.lit(0.5))
    turned = one(spark, *geometry.transform(geometry.q_matrix(q), p(1, 1, 1), p(1, 0, 0)), half[0], half[3], *geometry.bezier([p(0, 0), p(1, 2), p(2, 0)], F.lit(0.5)))
    assert turned == pytest.approx([1, 2, 1, math.cos(math.pi / 8), math.sin(math.pi / 8), 1, 1], abs=1e-12)


def test_symbolic():
    x, y = Symbol("x"), Symbol("y")
    assert simplify(x + x) == simplify(2 * x) and simplify(x * x**-1) == symbolic.lift(1) and simplify(x - x) == symbolic.lift(0)
    assert simplify(3 * x + 2 * (x + y)) == simplify(5 * x + 2 * y)
    e = call("exp", x * y) / (1 + x**2) + call("log", x) ** 3 - call("atan", x) * call("tanh", y) + call("sqrt", x) + x**y
    at = {"x": 1.3, "y": 0.7}
    for n in "xy":
        h = 1e-6
        slope = (evaluate(e, at | {n: at[n] + h}) - evaluate(e, at | {n: at[n] - h})) / (2 * h)
        assert evaluate(differentiate(e, n), at) == pytest.approx(slope, rel=1e-7)
        assert evaluate(simplify(e), at) == pytest.approx(evaluate(e, at))
    assert evaluate(substitute(e, {"y": 2}), {"x": 1.3}) == pytest.approx(evaluate(e, {"x": 1.3, "y": 2}))


def test_units(spark):
    v = units.quantity(F.lit(36.0), "km") / units.quantity(F.lit(1.0), "h")
    assert one(spark, v.to("m/s"), (v**2).sqrt().to("m/s")) == pytest.approx([10, 10])
    for wrong in (lambda: v + units.quantity(F.lit(1.0), "s"), lambda: v.to("kg"), lambda: units.quantity(F.lit(1.0), "furlong")):
        with pytest.raises(FathomError):
            wrong()
