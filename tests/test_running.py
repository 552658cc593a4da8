"""Running totals over ranges, rank correlation over blocks, and text formats that span lines."""

import itertools
import random

from pyspark.sql import functions as F

from fathom.operators import stats
from fathom.operators.running import running
from fathom.sources import text


def test_running_over_many_ranges(spark):
    rng = random.Random(0)
    rows = [(k, rng.choice([None, 1, 2, 5])) for k in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(7)
    for down in (False, True):
        got = {r.k: (r.s, r.most, r.n) for r in running(df, ["k"], down, s=("sum", F.col("v")), most=("max", F.col("v")), n=("sum", F.lit(1))).collect()}
        seen, n = [], 0
        for k, v in sorted(rows, reverse=down):
            n += 1
            seen += [v] * (v is not None)
            assert got[k] == (sum(seen) if seen else None, max(seen, default=None), n)
    assert running(df.limit(0), ["k"], s=("sum", F.col("v"))).collect() == []


def test_kendall_counts_pairs_across_blocks(spark):
    rng = random.Random(1)
    for values, n in ((6, 60), (1000, 150)):
        rows = [(float(rng.randrange(values)), float(rng.randrange(values))) for _ in range(n)] + [(None, 1.0)]
        pairs = rows[:-1]
        s = sum((a[0] < b[0] or -1) * ((a[1] < b[1]) - (a[1] > b[1])) for a, b in itertools.combinations(pairs, 2) if a[0] != b[0])
        tie = lambda k: sum(a[k] == b[k] for a, b in itertools.combinations(pairs, 2))
        n0 = n * (n - 1) / 2
        want = s / ((n0 - tie(0)) * (n0 - tie(1))) ** 0.5
        df = spark.createDataFrame(rows, "x double, y double")
        for block in (1 << 17, 7):
            assert abs(stats.kendall(df, "x", "y", block).first()[0] - want) < 1e-12


def test_formulas_and_programs_round_trip(spark, tmp_path):
    path = str(tmp_path / "f.cnf")
    with open(path, "w") as f:
        f.write("c a formula\np cnf 4 3\n1 -2\n 0 3 4 0\n-1\n-3 0\n")
    clauses = text.read_dimacs(spark, path)
    want = [(0, 1, False), (0, 2, True), (1, 3, False), (1, 4, False), (2, 1, True), (2, 3, True)]
    assert sorted(map(tuple, clauses.collect())) == want
    text.write_dimacs(clauses, 4, str(tmp_path / "g"))
    assert sorted(map(tuple, text.read_dimacs(spark, str(tmp_path / "g")).collect())) == want
    models = {r.model for r in text.sat_models(clauses, 4).collect()}
    assert models == {m for m in range(16) if (m & 1 or not m & 2) and (m & 4 or m & 8) and not (m & 1 and m & 4)}
    entries = spark.createDataFrame([(0, 1, 1, 1.5), (1, 1, 2, -2.0), (2, 2, 2, 1.0)], "k int, i int, j int, v double")
    text.write_sdpa([1.0, 0.25], entries, 2, str(tmp_path / "s"))
    b, back = text.read_sdpa(spark, str(tmp_path / "s"))
    assert b == [1.0, 0.25] and sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
