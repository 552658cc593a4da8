"""Interpolation, integration and fits on sampled data; information theory; signals; uncertainty; intervals; conjugate updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need
from fathom.session import spread


def interpolate(knots: DataFrame, queries: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Adds the linear interpolation of knots(by.., x, y) at queries(by.., x) as `y`; null outside the knots.

    Knots and queries are merged and each query sees the knots around it by window, which is one shuffle and no range join.
    Knots have distinct x in a series.
    """
    k = knots.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_q"), F.lit(None).cast("struct<%s>" % ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in queries.schema)).alias("_row"))
    q = queries.select(*by, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"))
    u = k.unionByName(q).withColumn("_k", F.when(F.col("_q") == 0, F.struct("_x", "_y")))
    w = W.partitionBy(*by).orderBy("_x", "_q")
    u = u.withColumn("_a", F.last("_k", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.first("_k", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    a, b = "_a", "_b"
    t = (F.col("_x") - F.col(f"{a}._x")) / (F.col(f"{b}._x") - F.col(f"{a}._x"))
    at = F.when(F.col("_x") == F.col(f"{a}._x"), F.col(f"{a}._y")).otherwise(F.col(f"{a}._y") + t * (F.col(f"{b}._y") - F.col(f"{a}._y")))
    return u.where("_q = 1").select("_row.*", at.alias("y"))


def trapezoid(df: DataFrame, x: str, y: str, by: list[str], tie: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(x, tie)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("integral"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of a column's values."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy())
    return g.select((-p * F.log2(p)).alias("h")).agg(F.sum("h").alias("entropy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information in bits, from the joint counts and their margins."""
    g = df.groupBy(a, b).agg(F.count("*").alias("n"))
    n = F.sum("n").over(W.partitionBy())
    x = g.select((F.col("n") / n).alias("p"), (F.sum("n").over(W.partitionBy(a)) / n).alias("pa"), (F.sum("n").over(W.partitionBy(b)) / n).alias("pb"))
    return x.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mutual_information"))


def divergences(df: DataFrame, column: str, first: Column, second: Column) -> DataFrame:
    """Between the distributions of column where first and where second hold: cross entropy, KL (null if unbounded), JS; in bits."""
    g = df.groupBy(column).agg(F.sum(F.when(first, 1).otherwise(0)).alias("a"), F.sum(F.when(second, 1).otherwise(0)).alias("b"))
    every = W.partitionBy()
    g = g.select((F.col("a") / F.sum("a").over(every)).alias("p"), (F.col("b") / F.sum("b").over(every)).alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = lambda x, y: F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)
    bounded = F.sum(F.when((p > 0) & (q == 0), 1).otherwise(0)) == 0
    return g.agg(F.when(bounded, F.sum(F.when((p > 0) & (q > 0), -p * F.log2(q)))).alias("cross_entropy"), F.when(bounded, F.sum(F.when((p > 0) & (q > 0), part(p, q)).otherwise(0.0))).alias("kl"), F.sum((part(p, m) + part(q, m)) / 2).alias("js"))


def fir(df: DataFrame, value: str, by: list[str], order: list[str], taps: list[float]) -> DataFrame:
    """Causal filter y_t = sum of taps[k] * x_(t-k), zero before the start."""
    need(bool(taps), "one tap at least")
    w = W.partitionBy(*by).orderBy(*order)
    y = sum((F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * float(c) for k, c in enumerate(taps) if k), F.col(value) * float(taps[0]))
    return df.withColumn("filtered", y)


def frames(df: DataFrame, value: str, by: list[str], order: list[str], size: int, hop: int) -> DataFrame:
    """Framing for short-time spectra: (by.., frame, position, value) of all full frames."""
    w = W.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_m", F.count("*").over(W.partitionBy(*by)))
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / hop)).cast("int")
    last = F.least(F.floor(F.col("_n") / hop), F.floor((F.col("_m") - size) / hop)).cast("int")
    x = x.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    return x.select(*by, "frame", (F.col("_n") - F.col("frame") * hop).alias("position"), value)


def dft_power(df: DataFrame, value: str, by: list[str], order: list[str], bins: int) -> DataFrame:
    """Power of the first `bins` frequencies of each series by direct sums: every sample meets every asked bin."""
    w = W.partitionBy(*by).orderBy(*order)
    x = df.select(*by, F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_n"), F.count("*").over(W.partitionBy(*by)).alias("_m"))
    x = x.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    a = -2 * F.pi() * F.pmod(F.col("bin") * F.col("_n"), F.col("_m")) / F.col("_m")
    return x.groupBy(*by, "bin").agg(F.sum(F.col("_v") * F.cos(a)).alias("re"), F.sum(F.col("_v") * F.sin(a)).alias("im")).select(*by, "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def product_uncertainty(a: Column, sa: Column, b: Column, sb: Column) -> tuple[Column, Column]:
    """Value and first-order standard deviation of a product of independent quantities."""
    return a * b, F.sqrt(b * b * sa * sa + a * a * sb * sb)


def interval_product(al: Column, au: Column, bl: Column, bu: Column) -> tuple[Column, Column]:
    p = [al * bl, al * bu, au * bl, au * bu]
    return F.least(*p), F.greatest(*p)


def complex_product(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def quaternion_rotate(q: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """v turned by the unit quaternion q = (w, x, y, z): v + 2w(u x v) + 2u x (u x v)."""
    w, x, y, z = q
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    t = cross((x, y, z), v)
    s = cross((x, y, z), t)
    return tuple(v[k] + 2 * w * t[k] + 2 * s[k] for k in range(3))


def overlaps(a: DataFrame, b: DataFrame, lo: str, hi: str, width: float, block: int = 2048) -> DataFrame:
    """Pairs of closed intervals (id, lo, hi) that overlap: equal-width cells are the join key, each pair kept in its first common cell.

    The intervals of a cell travel in blocks of about `block`, and pairs of blocks are dealt over the tasks: however many
    intervals share a cell, no task makes all its pairs.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.struct("id", F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi")).alias(name), F.explode(F.sequence(cell(lo), cell(hi))).alias("cell"))
        n = x.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("_n"))
        x = x.join(n, "cell").select("cell", name, F.pmod(F.xxhash64(f"{name}.id"), F.col("_n")).alias(f"{name}_block"))
        return x.groupBy("cell", f"{name}_block").agg(F.collect_list(name).alias(f"{name}s"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, x, y in zip(batch.column("cell").to_pylist(), batch.column("as"), batch.column("bs"), strict=True):
                (i, alo, ahi), (j, blo, bhi) = ([v.values.field(k) if k == "id" else v.values.field(k).to_numpy(zero_copy_only=False) for k in ("id", "lo", "hi")] for v in (x, y))
                afirst, bfirst = np.floor(alo / width), np.floor(blo / width)
                rows = max(1, 1_000_000 // len(blo))
                for k in range(0, len(alo), rows):
                    n = slice(k, k + rows)
                    # both reach this cell, and one of them begins in it
                    at, by = np.nonzero((alo[n, None] <= bhi) & (blo <= ahi[n, None]) & ((afirst[n, None] == c) | (bfirst == c)))
                    yield pa.RecordBatch.from_arrays([i.take(pa.array(at + k)), j.take(pa.array(by))], names=["a_id", "b_id"])

    kinds = [x.schema["id"].dataType.simpleString() for x in (a, b)]
    p = spread(blocks(a, "a").join(blocks(b, "b"), "cell"), "cell", "a_block", "b_block", each=32)
    return p.select("cell", "as", "bs").mapInArrow(pairs, f"a_id {kinds[0]}, b_id {kinds[1]}")


def beta_binomial(df: DataFrame, by: list[str], success: Column, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """Posterior of a rate by group: alpha, beta, mean."""
    g = df.groupBy(*by).agg((F.sum(F.when(success, 1).otherwise(0)) + a).alias("alpha"), (F.sum(F.when(success, 0).otherwise(1)) + b).alias("beta"))
    return g.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def gamma_poisson(df: DataFrame, by: list[str], shape: float = 1.0, rate: float = 1.0, unit: str = "user_id") -> DataFrame:
    """Posterior of a rate of rows a unit by group: shape, rate, mean."""
    g = df.groupBy(*by).agg((F.count("*") + shape).alias("shape"), (F.countDistinct(unit) + rate).alias("rate"))
    return g.withColumn("mean", F.col("shape") / F.col("rate"))
