import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.errors import ColumnError, FathomError
from fathom.operators import graph, matrix, models, numeric, resampling, stats, timeseries


def test_validation(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    with pytest.raises(ColumnError):
        stats.describe(df, "y", ["g"])
    with pytest.raises(FathomError):
        timeseries.sma(df, "x", ["g"], ["x"], 0)
    with pytest.raises(FathomError):
        stats.p_adjust(df, "x", "none", "g")


def test_kendall_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert stats.kendall(df, "x", "y").first().tau_b == pytest.approx(0.5)


def test_ks_extremes(spark):
    a, b = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), spark.createDataFrame([(4.0,), (5.0,)], "y double")
    assert stats.ks_two_sample(a, "x", b, "y").first().d == 1.0
    assert stats.ks_two_sample(a, "x", a, "x").first().d == 0.0


def test_anova_degenerate(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double")
    assert stats.anova(one, "x", "g").first().f_statistic is None
    assert stats.anova(one.limit(0), "x", "g").first().f_statistic is None


def test_wls_fixture(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 3.0, 4.0), (3.0, 2.0, 1.0), (4.0, 5.0, 9.0)], "x double, y double, w double")
    got = {r.term: r.coefficient for r in models.linear_model(df, "y", ["x"], weight=F.col("w")).collect()}
    assert got["intercept"] == pytest.approx(0.29268293) and got["x"] == pytest.approx(1.15853659)


def test_logistic_against_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int")
    w, a = np.zeros(2), np.column_stack([np.ones(400), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (y - p))
    got = {r.term: r.coefficient for r in models.logistic(df, "y", ["x"]).collect()}
    assert [got["intercept"], got["x"]] == pytest.approx(w.tolist(), abs=1e-6)


def test_auc_fixture(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert models.auc(df, "y", "s").first().auc == 1.0


def test_ema_of_one_is_identity_and_sma_rows(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(10)], "k string, t long, x double")
    assert [r.ema for r in timeseries.ema(df, "x", ["k"], ["t"], 1.0).orderBy("t").collect()] == [float(i * i) for i in range(10)]
    assert timeseries.sma(df, "x", ["k"], ["t"], 4).count() == 7


def test_coo_merge_and_power_iteration(spark):
    a = matrix.coo(spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 0, 1.0)], "i int, j int, v double"), "i", "j", "v")
    assert a.count() == 3
    t = spark.createDataFrame([(0, 0, 2.0), (1, 1, 2.0), (2, 2, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 2, -1.0), (2, 1, -1.0)], "i int, j int, v double")
    _, d = matrix.power_iteration(matrix.add(t, t.limit(0)), rounds=60, tol=1e-5)
    assert d["converged"] or d["eigenvalue"] == pytest.approx(2 + 2**0.5, abs=1e-3)


def test_shortest_paths_and_sinks(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 5.0), (4, 1, 1.0)], "src int, dst int, w double")
    assert {r.id: r.distance for r in graph.shortest_paths(e, 1).collect()} == {1: 0.0, 2: 1.0, 3: 3.0}
    ranks = {r.id: r.rank for r in graph.pagerank(e, rounds=30).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == 3


def test_interval_join_against_pairs(spark):
    rng = random.Random(0)
    a = [(i, x := rng.uniform(-9, 9), x + rng.uniform(0, 5)) for i in range(40)]
    b = [(i, x := rng.uniform(-9, 9), x + rng.uniform(0, 5)) for i in range(40)]
    df = [spark.createDataFrame(x, "id int, lo double, hi double") for x in (a, b)]
    want = sorted((p, q) for p, l, h in a for q, m, k in b if l <= k and m <= h)
    assert sorted(map(tuple, numeric.overlaps(*df, "lo", "hi", 1.5).collect())) == want


def test_interpolation_fixture(spark):
    k = spark.createDataFrame([("a", float(x), 2.0 * x) for x in range(4)], "s string, x double, y double")
    q = spark.createDataFrame([("a", 1.25), ("a", 3.0), ("a", 4.0)], "s string, x double")
    assert {r.x: r.y for r in numeric.interpolate(k, q, "x", "y", ["s"]).collect()} == {1.25: 2.5, 3.0: 6.0, 4.0: None}


def test_resampling_is_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    a, b = (resampling.bootstrap_mean(df.repartition(n), "x", "id", 100).first() for n in (2, 5))
    assert a.lower == pytest.approx(b.lower) and a.lower < 3.0 < a.upper
    assert resampling.mc_integrate(spark, lambda x: x, 0, 2, 20_000).first().integral == pytest.approx(2, abs=0.03)
