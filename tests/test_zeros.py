"""Parts and angles that are zero come out as zero where their terms cancel, and small ones that are not stay."""

import pytest
from pyspark.sql import functions as F

from fathom.catalog import QUERIES
from fathom.functions import complexes, rigid
from fathom.plans import calculus, closed  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("zeros")
    rows = [(k, q, float(quantity), disc / 100, tax / 100) for k, (q, quantity, disc, tax) in enumerate((q, n, i, j) for q, n in enumerate((1, 17, 25, 50)) for i in range(11) for j in range(9))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def test_imaginary_numbers_come_back_from_inverses_without_a_real_part(spark, sf_dir):
    at = {r.l_orderkey: r for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()}
    names = ("asin", "acos", "atan", "asinh", "acosh")
    for r in QUERIES["complex_inverses"](spark, sf_dir).collect():
        a, b = (at[r.l_orderkey].l_quantity - 25) / 20, at[r.l_orderkey].l_discount * 10 + 0.25
        for k in names:
            # abs=0: zero is to be zero
            assert r[f"{k}_re"] == pytest.approx(a, rel=1e-9, abs=0) and r[f"{k}_im"] == pytest.approx(b, rel=1e-9, abs=0)
        assert r.root0_re == pytest.approx(-a, rel=1e-9, abs=0)


def test_settled_keeps_small_parts(spark):
    z = [complexes.settled((F.lit(a), F.lit(b))) for a, b in ((1e-12, 1.0), (1.0, -1e-12), (1e-300, 0.0), (1e-17, 1.0), (0.0, 0.0))]
    got = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(x for p in z for x in p))).first()
    assert tuple(got) == (1e-12, 1.0, 1.0, -1e-12, 1e-300, 0.0, 0.0, 1.0, 0.0, 0.0)


def test_angles_that_are_zero_come_back_as_zero(spark, sf_dir):
    at = {r.l_orderkey: r for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()}
    for r in QUERIES["rigid_motions"](spark, sf_dir).collect():
        line = at[r.l_orderkey]
        want = (line.l_discount * 10, line.l_tax * 10, (line.l_quantity - 25) / 10)
        assert (r.euler_x, r.euler_y, r.euler_z) == pytest.approx(want, rel=1e-9, abs=0)


def test_small_angles_are_kept(spark):
    turns = [rigid.to_euler(tuple(F.lit(x) for x in q)) for q in ((1.0, 5e-18, 0.0, 0.0), (1.0, 0.0, 5e-18, 0.0), (1.0, 0.0, 0.0, 5e-18))]
    got = spark.range(1).select(*(t[k].alias(f"a{k}") for k, t in enumerate(turns))).first()
    assert tuple(got) == pytest.approx((1e-17,) * 3, rel=1e-9, abs=0)
