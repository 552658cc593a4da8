"""k-NN whose queries do not fit one block."""

from collections import Counter

import numpy as np

from fathom.operators import models


def test_knn_answers_all_blocks(spark):
    rng = np.random.default_rng(3)
    v, y = rng.integers(-9, 10, (60, 3)), rng.integers(0, 4, 60)
    points = spark.createDataFrame([(i, [float(x) for x in v[i]], int(y[i])) for i in range(60)], "id long, v array<double>, y int")
    got = {r.q_id: r.predicted for r in models.knn(points, points.where("id % 2 = 0"), "id", "v", "y", 5, most_queries=7).collect()}
    want = {}
    for q in range(0, 60, 2):
        near = sorted((int(((v[i] - v[q]) ** 2).sum()), i) for i in range(60) if i != q)[:5]
        want[q] = max(Counter(int(y[i]) for _, i in near).items(), key=lambda x: (x[1], -x[0]))[0]
    assert got == want
