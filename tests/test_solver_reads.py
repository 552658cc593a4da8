"""Work is not done twice, nor all by one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import numeric, tensor


@pytest.mark.parametrize("diagonal", [True, False])
def test_conjugate_gradients_work_their_matrix_out_once(spark, diagonal):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for b in rows:
            seen.add(len(b))
            yield b

    n = 6
    m = np.diag(np.arange(3.0, 3 + n)) - np.diag([1.0] * (n - 1), 1) - np.diag([1.0] * (n - 1), -1)
    entries = [(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
    a = spark.createDataFrame(entries, "i int, j int, v double").mapInPandas(counted, "i int, j int, v double")
    x, told = tensor.conjugate_gradient(a, spark.createDataFrame([(i, float(i)) for i in range(n)], "i int, v double"), diagonal=diagonal)
    assert told["converged"] and told["rounds"] > 2
    assert [r.v for r in x.orderBy("i").collect()] == pytest.approx(np.linalg.solve(m, np.arange(n)).tolist())
    assert seen.value == len(entries)


def test_conjugate_gradients_of_nothing(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 2.0)], "i int, j int, v double")
    x, told = tensor.conjugate_gradient(a, spark.range(2).select(F.col("id").cast("int").alias("i"), F.lit(0.0).alias("v")))
    assert told["converged"] and [r.v for r in x.collect()] == [0.0, 0.0]


def test_intervals_of_one_cell_are_paired_by_many_tasks(spark):
    # all in one cell, and some across cells
    rows = [(k, k % 7 / 10, k % 7 / 10 + 0.05 + k % 3) for k in range(300)]
    a = spark.createDataFrame(rows, "id long, lo double, hi double")
    got = numeric.overlaps(a, a, "lo", "hi", 2.0, block=50)
    pairs = got.select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.a_id, r.b_id) for r in pairs) == sorted((i, j) for i, x, y in rows for j, u, v in rows if x <= v and u <= y)
    tasks = {}
    for r in pairs:
        tasks[r.task] = tasks.get(r.task, 0) + 1
    assert len(tasks) > 10 and max(tasks.values()) < len(pairs) / 5


def test_nearest_points_with_ties_and_odd_vectors(spark):
    from fathom.operators import models

    g = np.random.default_rng(2)
    rows = [(k, [float(v) for v in g.integers(-2, 3, 3)], k % 3) for k in range(400)] + [(900, None, 0), (901, [1.0, None, 0.0], 1), (902, [1.0, 2.0], 2), (903, [1e8, 1e8 + 1e-7, 1e8], 1), (904, [1e8, 1e8, 1e8], 2)]
    df = spark.createDataFrame(rows, "id long, x array<float>, label int")
    out = models.knn(df, df.where("id % 10 = 0 or id > 900"), "id", "x", "label", 5)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.q_id: r.predicted for r in out.collect()}
    held = {k: None if x is None or None in x else np.array(x, np.float32).astype(float) for k, x, _ in rows}
    label = {k: c for k, _, c in rows}
    for q in (k for k in held if k % 10 == 0 or k > 900):
        away = lambda k, q=q: float(sum((held[q] - held[k]) ** 2)) if held[q] is not None and held[k] is not None and len(held[q]) == len(held[k]) else np.inf
        near = sorted((k for k in held if k != q), key=lambda k: (away(k), k))[:5]
        votes = [label[k] for k in near]
        assert got[q] == min(set(votes), key=lambda c: (-votes.count(c), c))


def test_medians_hold_no_groups_values(spark):
    from fathom.operators import stats

    g = np.random.default_rng(5)
    rows = [("abc"[k % 3] if k % 50 else None, float(v) if k % 40 else None) for k, v in enumerate(g.integers(0, 60, 500))] + [("one", 7.0), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: float(np.median([v for j, v in rows if j == k and v is not None])) for k in {j for j, _ in rows} - {None}}
    assert {r.k: r.median for r in stats.medians(df, "v", "k").collect()} == want
    plan = stats.levene(df, "v", "k")._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan
