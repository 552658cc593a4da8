import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import columns, local, special


def test_special_values():
    assert special.gamma_q(2, 4) == pytest.approx(0.0915781944, abs=1e-9)
    assert special.gamma_q(0.5, 2) == pytest.approx(0.0455002639, abs=1e-9)
    assert special.t_sf2(1.96, 1000) == pytest.approx(0.0503, abs=1e-4)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.0, 1, 10) == pytest.approx(special.t_sf2(2.0, 10), abs=1e-12)
    assert special.ks_sf(0.1, 50) == pytest.approx(0.67662, abs=0.02)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.chi2_sf(300, 2) == pytest.approx(math.exp(-150), rel=1e-10)
    assert float(special.erf(0.5)) == pytest.approx(math.erf(0.5))
    assert math.isnan(special.gamma_p(-1, 2)) and special.beta_i(2, 3, 0) == 0 and special.beta_i(2, 3, 1) == 1


def test_special_column_skips_nulls(spark):
    df = spark.createDataFrame([(3.841459,), (None,)], "x double")
    got = [r.p for r in df.select(special.column("chi2_sf", "x", 1).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None


def test_columns(spark):
    r = spark.range(1).select(
        columns.quadratic_roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)).alias("two"), columns.quadratic_roots(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("none"), columns.quadratic_roots(F.lit(0.0), F.lit(2.0), F.lit(-4.0)).alias("line"),
        columns.softplus(F.lit(800.0)).alias("sp"), columns.laplace_cdf(F.lit(0.0)).alias("l"), columns.triangle_area(*map(F.lit, (0, 0, 4, 0, 0, 3))).alias("area"), columns.poisson_pmf(F.lit(2), 3.0).alias("pois"),
        columns.weibull_cdf(columns.weibull_quantile(F.lit(0.3), 1.5, 2.0), 1.5, 2.0).alias("w"), columns.complex_quotient(*map(F.lit, (1.0, 2.0, 3.0, -4.0)))[0].alias("cq"),
    ).first()
    assert r.two == [1.0, 2.0] and r.none == [] and r.line == [2.0]
    assert r.sp == 800.0 and r.l == 0.5 and r.area == 6.0 and r.pois == pytest.approx(math.exp(-3) * 4.5) and r.w == pytest.approx(0.3) and r.cq == pytest.approx(-0.2)


def test_local_kernels(spark):
    assert local.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    assert local.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0) == pytest.approx(math.sqrt(2))
    assert local.golden_section(lambda x: (x - 1.5) ** 2, 0, 4) == pytest.approx(1.5, abs=1e-6)
    assert local.simpson(math.sin, 0, math.pi) == pytest.approx(2, abs=1e-9)
    point, d = local.bfgs(lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2, [-1.2, 1.0])
    assert d["converged"] and point == pytest.approx([1, 1], abs=1e-4)
    assert local.gradient(lambda v: v[0] ** 2 * v[1] + math.sin(v[0]), np.array([1.5, 2.0])) == pytest.approx([6 + math.cos(1.5), 2.25], abs=1e-8)
    df = spark.createDataFrame([(1, [0.0, 1.0], 1.0), (2, [1.0, 0.0], 1.0)], "id long, y0 array<double>, w double")
    got = {r.id: r.y for r in local.ensemble(df, "id", lambda t, y, r: np.array([y[1], -r.w * y[0]]), "y0", math.pi, 400).collect()}
    assert got[2][0] == pytest.approx(-1, abs=1e-6) and got[1][1] == pytest.approx(-1, abs=1e-6)
