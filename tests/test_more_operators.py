import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import solvers
from fathom.operators import forecasting, learning, tensor


@pytest.fixture(scope="module")
def series(spark):
    g = np.random.default_rng(1)
    x, e = [0.0, 0.0], g.standard_normal(400)
    for k in range(400):
        x.append(0.5 * x[-1] - 0.3 * x[-2] + float(e[k]))
    rows = [("a", k, v + 10) for k, v in enumerate(x)] + [("flat", k, 2.0) for k in range(9)] + [("short", 0, 1.0), ("null", 0, None)]
    return spark.createDataFrame(rows, "s string, t int, v double")


def test_autoregression(spark, series):
    m = {r.s: r for r in forecasting.fit_ar(series, "v", ["s"], ["t"], 4, best=True).collect()}
    x = np.array([r.v for r in series.where("s = 'a'").orderBy("t").collect()])
    d = x - x.mean()
    r = [float((d[k:] * d[: len(d) - k]).sum() / (d * d).sum()) for k in range(4)]
    phi = np.linalg.solve([[1, r[1]], [r[1], 1]], r[1:3])  # the normal equations, without the recursion
    assert m["a"].p == 2 and m["a"].phi == pytest.approx(phi.tolist()) and m["a"].sigma2 == pytest.approx(d.var() * (1 - phi @ r[1:3]))
    assert m["flat"].phi is None and m["short"].phi is None
    f = {(r.s, r.h): r.forecast for r in forecasting.forecast_ar(series, "v", ["s"], ["t"], 2, 2).collect()}
    assert f["flat", 2] == 2.0 and len([k for k in f if k[0] == "a"]) == 2
    p = {r.lag: r.pacf for r in forecasting.partial_autocorrelation(series.where("s = 'a'"), "v", ["s"], ["t"], 3).collect()}
    third = np.linalg.solve([[1, r[1], r[2]], [r[1], 1, r[1]], [r[2], r[1], 1]], r[1:4])[2]
    assert [p[1], p[2], p[3]] == pytest.approx([r[1], phi[1], third])
    assert forecasting.dickey_fuller(series.where("s = 'a'"), "v", ["s"], ["t"]).first().t < -8
    assert forecasting.kpss(series.where("s = 'a'"), "v", ["s"], ["t"], 5).first().kpss < 0.463


def test_variance_and_vectors(spark, series):
    r = {x.s: x for x in forecasting.fit_garch(series, "v", ["s"], ["t"]).collect()}
    assert 0 <= r["a"].alpha + r["a"].beta < 1 and r["flat"].omega is None
    g, x, rows = np.random.default_rng(2), np.zeros(2), []
    a = np.array([[0.6, 0.2], [0.0, 0.5]])
    for k in range(800):
        x = np.array([1.0, 2.0]) + a @ x + g.standard_normal(2) * 0.5
        rows.append((k, float(x[0]), float(x[1])))
    c, m = forecasting.var1(spark.createDataFrame(rows, "t int, u double, w double"), ["u", "w"], ["t"])
    assert np.abs(m - a).max() < 0.12 and forecasting.impulse_response(m, 2)[2] == pytest.approx(m @ m)


def test_constant_and_empty_inputs_give_nulls(spark):
    from fathom.operators import stats, timeseries

    flat = spark.createDataFrame([("a", k, 2.0, "x" if k < 3 else "y") for k in range(6)], "s string, t int, v double, g string")
    for df in (flat, flat.limit(1), flat.limit(0)):
        for out in (
            stats.t_one_sample(df, "v", 2.0), stats.t_two_sample(df, "v", "g", "x", "y", pooled=True), stats.t_two_sample(df, "v", "g", "x", "y", pooled=False), stats.anova(df, "v", "g"), stats.mann_whitney(df, "v", "g", "x", "y"), stats.kruskal(df, "v", "g"),
            stats.chi2_independence(df, "s", "g"), stats.chi2_gof(df, "g"), stats.simple_ols(df, "t", "v"), stats.z_two_proportion(df, "g", "x", "y", F.col("v") > 1), timeseries.ljung_box(df, "v", ["s"], ["t"], 2), timeseries.ccf(df, "v", "t", ["s"], ["t"], 1),
            forecasting.kpss(df, "v", ["s"], ["t"], 1), forecasting.dickey_fuller(df, "v", ["s"], ["t"]), forecasting.granger_one_lag(df, "v", "t", ["s"], ["t"]),
        ):
            out.collect()
    assert timeseries.acf(flat, "v", ["s"], ["t"], 1).first().r is None and stats.t_one_sample(flat, "v", 2.0).first().t is None


def test_learning(spark):
    g = np.random.default_rng(3)
    x = g.standard_normal((600, 3))
    rows = [(k, *map(float, r), float(3 + 2 * r[0] - r[1]), int(g.poisson(math.exp(0.5 + 0.8 * r[0]))), int(r[0] > 0.2) + int(r[1] > 0)) for k, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (999, None, 0.0, 0.0, 1.0, 1, 0)], "id int, a double, b double, c double, y double, n int, k int")
    names = ["a", "b", "c"]
    lasso = {r.term: r.coefficient for r in learning.elastic_net(df, "y", names, 0.3).collect()}
    assert lasso["c"] == pytest.approx(0, abs=1e-9) and 1.4 < lasso["a"] < 2 and -1 < lasso["b"] < -0.4
    exact = {r.term: r.coefficient for r in learning.elastic_net(df, "y", names, 0.0).collect()}
    assert [exact[t] for t in ("intercept", *names)] == pytest.approx([3, 2, -1, 0], abs=1e-6)
    counts = {r.term: r.coefficient for r in learning.poisson_regression(df, "n", ["a"]).collect()}
    assert counts["intercept"] == pytest.approx(0.5, abs=0.15) and counts["a"] == pytest.approx(0.8, abs=0.12)
    tree = learning.decision_tree(df, "k", ["a", "b"], depth=2)
    right = df.dropna().select((learning.tree_predict(df, tree) == F.col("k")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.9
    cv = learning.cross_validated_mse(df, "y", names, "id", 4).collect()
    assert len(cv) == 4 and max(r.mse for r in cv) < 1e-6 and sum(r.n for r in cv) == 600
    assert {r["class"] for r in learning.softmax_fit(df, "k", ["a", "b"], rounds=3).collect()} == {0, 1, 2}


def test_exact_tests(spark):
    df = spark.createDataFrame([(True, True)] * 8 + [(True, False)] * 2 + [(False, True)] * 1 + [(False, False)] * 5, "a boolean, b boolean")
    assert learning.fisher_exact(df, F.col("a"), F.col("b")).first().p_value == pytest.approx(0.0349650349, abs=1e-8)
    u = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("v"))
    assert learning.ks_one_sample(u, "v", lambda v: v).first().d == pytest.approx(0.0005)
    assert learning.ks_one_sample(u.limit(0), "v", lambda v: v).count() == 0


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def test_tensors(spark):
    g = np.random.default_rng(4)
    a, b = g.integers(-3, 4, (3, 4, 2)).astype(float), g.integers(-3, 4, (2, 4)).astype(float)
    rows = lambda t: spark.createDataFrame([(*map(int, ix), float(v)) for ix, v in np.ndenumerate(t) if v], ", ".join(f"i{k} int" for k in range(t.ndim)) + ", v double")
    x, y = rows(a), rows(b)
    assert (dense(tensor.contract(x, y, [(2, 0), (1, 1)]), (3,)) == np.einsum("ijk,kj->i", a, b)).all()
    assert (dense(tensor.permute(x, [2, 0, 1]), (2, 3, 4)) == a.transpose(2, 0, 1)).all()
    assert (dense(tensor.concatenate(x, tensor.slice_axis(x, 1, 1, 3), 1, 4), (3, 6, 2)) == np.concatenate([a, a[:, 1:3]], axis=1)).all()
    assert tensor.norm(x, 1.0).first()[0] == np.abs(a).sum() and tensor.norm(x.limit(0)).first()[0] == 0
    assert sum(r.v for r in tensor.softmax_axis(y, 1).where("i0 = 0").collect()) == pytest.approx(1)


def test_solvers_on_rows(spark):
    n = 6
    a = spark.createDataFrame([(i, j, 2.5 if i == j else -1.0) for i in range(n) for j in range(n) if abs(i - j) < 2], "i int, j int, v double")
    x, d = tensor.conjugate_gradient(a, spark.createDataFrame([(i, float(i)) for i in range(n)], "i int, v double"))
    m = np.diag([2.5] * n) - np.diag([1.0] * (n - 1), 1) - np.diag([1.0] * (n - 1), -1)
    assert d["converged"] and [r.v for r in x.orderBy("i").collect()] == pytest.approx(np.linalg.solve(m, np.arange(n)).tolist())
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0), (2, 4, 4.0), (7, 8, 2.0), (8, 8, 1.0)], "src int, dst int, w double")
    t = tensor.minimum_spanning_forest(e).collect()
    assert len(t) == 4 and sum(r.w for r in t) == 8.0


def test_local_solvers(spark):
    t, y, _ = solvers.rk45(lambda t, y: np.array([y[1], -y[0]]), [0.0, 1.0], 0.0, math.pi)
    assert y == pytest.approx([0, -1], abs=1e-6) and t == pytest.approx(math.pi)
    t, y, d = solvers.rk45(lambda t, y: np.array([y[1], -1.0]), [1.0, 0.0], 0.0, 9.0, event=lambda t, y: y[0])
    assert d["event"] and t == pytest.approx(math.sqrt(2), abs=1e-6)
    for method, tol in (("euler", 0.02), ("trapezoid", 1e-4), ("bdf2", 1e-3)):
        assert solvers.implicit(lambda t, y: -50 * (y - math.cos(t)), [1.0], 0.0, 1.0, 400, method)[0] == pytest.approx((2500 * math.cos(1) + 50 * math.sin(1)) / 2501, abs=tol)
    x, v = solvers.verlet(lambda x: -x, [1.0], [0.0], 0.01, 628)
    assert x[0] ** 2 + v[0] ** 2 == pytest.approx(1, abs=1e-3)
    grid = np.linspace(0, 1, 51)
    assert solvers.reaction_diffusion(np.sin(np.pi * grid), 0.02, 0.001, 100, 1.0)[25] == pytest.approx(math.exp(-math.pi**2 * 0.1), abs=1e-3)
    assert solvers.wave(np.sin(np.pi * grid), 0 * grid, 0.02, 0.01, 100, 1.0)[25] == pytest.approx(-1, abs=1e-3)
    u = solvers.conservation(np.sin(2 * np.pi * grid[:-1]), 0.02, 0.01, 50, lambda u: u * u / 2, lambda u: u, 0.001)
    assert abs(u.sum()) < 1e-9 and np.abs(u).max() < 1
    k, j = np.meshgrid(grid, grid, indexing="ij")
    assert np.abs(solvers.poisson_2d(np.full((51, 51), 4.0), k * k + j * j, 0.02) - (k * k + j * j)).max() < 1e-10
    rosen = lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2
    assert solvers.nelder_mead(rosen, [-1.2, 1.0])[0] == pytest.approx([1, 1], abs=1e-4)
    assert solvers.differential_evolution(rosen, [-2, -2], [2, 2])[0] == pytest.approx([1, 1], abs=1e-2)
    assert solvers.adam(lambda x: 2 * (x - 3), [0.0])[0] == pytest.approx(3, abs=1e-3)
    e = [np.diag([1.0, 0.0]), np.diag([0.0, 1.0])]
    x, d = solvers.semidefinite(np.diag([1.0, 2.0]), e, [1.0, 1.0])
    assert d["converged"] and d["objective"] == pytest.approx(3, abs=1e-5)
    x, d = solvers.semidefinite(np.array([[0.0, 1.0], [1.0, 0.0]]), e, [1.0, 1.0])
    assert d["objective"] == pytest.approx(-2, abs=1e-4) and np.linalg.eigvalsh(x).min() > -1e-9
    chain, rate = solvers.metropolis(lambda v: -(v @ v) / 2, [0.0], 2.0, 8000)
    assert chain.std() == pytest.approx(1, abs=0.12) and 0.2 < rate < 0.8 and 200 < solvers.effective_size(chain[:, 0]) < 8000
    h = solvers.hamiltonian(lambda v: -(v @ v) / 2, lambda v: -v, [0.0], 0.3, 5, 2000)
    assert h.std() == pytest.approx(1, abs=0.15) and solvers.r_hat(np.stack([h[:1000, 0], h[1000:, 0]])) < 1.1
    low = solvers.filter_sections([1.0] * 300, solvers.butterworth_sections(5, 0.1))
    high = solvers.filter_sections([1.0] * 300, solvers.butterworth_sections(4, 0.1, high=True))
    assert low[-1] == pytest.approx(1, abs=1e-6) and high[-1] == pytest.approx(0, abs=1e-6)
    tone = np.sin(2 * np.pi * 0.125 * np.arange(512))
    f, p = solvers.welch(tone, 64)
    assert f[p.argmax()] == 0.125 and solvers.envelope(tone) == pytest.approx(np.ones(512), abs=1e-9)
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, w double")
    got = {r.id: r.y[0] for r in solvers.each(df, "id", lambda r: solvers.rk45(lambda t, y: -r.w * y, [1.0], 0.0, 1.0)[1]).collect()}
    assert got[1] == pytest.approx(math.exp(-2), abs=1e-6) and got[2] == pytest.approx(math.exp(-3), abs=1e-6)


def test_smoothing_is_the_joint_solution(spark):
    """First level is the first value with variance p0; the smoothed levels minimise all squared terms together."""
    q, r, p0, z = 0.5, 4.0, 1.0, [1.0, 4.0, 2.0, 7.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(z)], "s string, t int, v double")
    got = [x.level for x in forecasting.kalman_smooth(df, "v", ["s"], ["t"], q, r, ["t"], p0).orderBy("t").collect()]
    m, b = np.zeros((4, 4)), np.zeros(4)
    m[0, 0], b[0] = 1 / p0, z[0] / p0
    for k in range(1, 4):
        m[k, k] += 1 / r
        b[k] += z[k] / r
        m[k - 1 : k + 1, k - 1 : k + 1] += np.array([[1, -1], [-1, 1]]) / q
    assert got == pytest.approx(np.linalg.solve(m, b).tolist())
