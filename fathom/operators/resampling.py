"""Monte Carlo and resampling with hash-seeded draws: the same numbers however often a task runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.columns import hash_uniform


def mc_integrate(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, n: int, seed: int = 0) -> DataFrame:
    """Mean and standard error of the integral of f over [a, b] from n draws."""
    y = f(a + (b - a) * hash_uniform(F.col("id"), seed=seed)) * (b - a)
    return spark.range(n).agg(F.avg(y).alias("integral"), (F.stddev_samp(y) / F.sqrt(F.lit(n))).alias("std_error"))


def bootstrap_mean(df: DataFrame, value: str, key: str, replicates: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: every row has an own Poisson(1) weight in each replicate,
    so replicates are one partial aggregate and rows never move."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(key).alias("k"))
    x = x.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = hash_uniform(F.col("k"), F.col("r"), seed=seed)
    # cumulative Poisson(1) probabilities 1/e * sum 1/k!
    w, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(10):
        total += term
        w = w + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    m = x.withColumn("w", w).groupBy("r").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit((1 - level) / 2)).alias("lower"), F.percentile("m", F.lit((1 + level) / 2)).alias("upper"))


def permutation_p(df: DataFrame, value: str, label: Column, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """Two-sided permutation p of the difference of means: labels are drawn anew with the same rate in each round."""
    x = df.select(F.col(value).alias("v"), label.cast("int").alias("y"), F.col(key).alias("k")).dropna()
    one = x.agg(F.avg("y"), F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))).first()
    if one[0] is None or one[1] is None:
        return df.sparkSession.createDataFrame([], "difference double, p double")
    z = x.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("y", hash_uniform(F.col("k"), F.col("r"), seed=seed) < one[0])
    d = z.groupBy("r").agg((F.avg(F.when(F.col("y"), F.col("v"))) - F.avg(F.when(~F.col("y"), F.col("v")))).alias("d"))
    return d.agg(F.lit(one[1]).alias("difference"), ((F.sum(F.when(F.abs("d") >= abs(one[1]), 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias("p"))
