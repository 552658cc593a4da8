"""Sparse matrices as (i, j, v) rows: joins and aggregates, no dense copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise


def coo(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """Entries with duplicates summed."""
    return df.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum(v).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    u = a.select("i", "j", (F.col("v") * alpha).alias("v")).union(b.select("i", "j", (F.col("v") * beta).alias("v")))
    return u.groupBy("i", "j").agg(F.sum("v").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a @ b: join on the inner index, sum of products."""
    x, y = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_a")), b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return x.join(y, "_k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """a @ x for x(i, v)."""
    y = x.select(F.col("i").alias("j"), F.col("v").alias("_x"))
    return a.join(y, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def norms(a: DataFrame) -> DataFrame:
    """Frobenius, one (largest column sum), infinity (largest row sum) and largest-entry norms, and the trace."""
    r = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("inf_norm"))
    c = a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("one_norm"))
    e = a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"), F.max(F.abs("v")).alias("max_norm"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("trace"))
    return e.join(F.broadcast(r)).join(F.broadcast(c))  # one row each


def is_symmetric(a: DataFrame, tol: float = 1e-12) -> DataFrame:
    gap = add(a, transpose(a), 1.0, -1.0).agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("gap"))
    return gap.select((F.col("gap") <= tol).alias("symmetric"), "gap")


def power_iteration(a: DataFrame, rounds: int = 100, tol: float = 1e-9) -> tuple[DataFrame, dict]:
    """Dominant eigenvector (i, v) of a square matrix, and its diagnostics: eigenvalue, residual, rounds, converged."""
    x = materialise(a.select("i").union(a.select("j")).distinct().withColumn("v", F.lit(1.0)))
    value = residual = float("inf")
    for k in range(1, rounds + 1):
        y = materialise(spmv(a, x))
        size = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        if size == 0:
            return x, {"eigenvalue": 0.0, "residual": 0.0, "rounds": k, "converged": True}
        j = x.select("i", F.col("v").alias("x")).join(y, "i", "left").select(F.col("x"), F.coalesce("v", F.lit(0.0)).alias("y"))
        xy, xx = j.agg(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).first()
        value = xy / xx
        residual = (j.agg(F.sum((F.col("y") - value * F.col("x")) ** 2)).first()[0] / xx) ** 0.5
        x = materialise(x.select("i").join(y.select("i", (F.col("v") / size).alias("v")), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v")))
        if residual <= tol * max(1.0, abs(value)):
            return x, {"eigenvalue": value, "residual": residual, "rounds": k, "converged": True}
    return x, {"eigenvalue": value, "residual": residual, "rounds": rounds, "converged": False}
