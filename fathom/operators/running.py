"""Running sums, minima and maxima over a whole table in order, without one task that sees all rows.

Rows are dealt to ranges of the order and written; totals of the ranges (a row each) are run over, and each range adds
what came before it to its own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.session import materialise, unused

HOW = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, order: list[str], descending: bool = False, **columns: tuple[str, Column]) -> DataFrame:
    """df with a column for each name=(how, column): the sum, min or max of the column over all rows up to this one. Rows
    that are equal in order come in any order, so order should tell all rows apart."""
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    (at,) = unused(df, "range")
    x = materialise(df.repartitionByRange(*by).withColumn(at, F.spark_partition_id()), "ranges")
    w = W.partitionBy(at).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    totals = x.groupBy(at).agg(*(HOW[how][0](c).alias(f"_{k}") for k, (how, c) in columns.items()))
    # one row a range
    up = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(at, *(HOW[how][0](f"_{k}").over(up).alias(f"_{k}") for k, (how, _) in columns.items()))
    own = x.select("*", *(HOW[how][0](c).over(w).alias(k) for k, (how, c) in columns.items())).join(F.broadcast(before), at)
    return own.select(*df.columns, *(F.when(F.col(f"_{k}").isNull(), F.col(k)).otherwise(HOW[how][1](F.col(k), F.col(f"_{k}"))).alias(k) for k, (how, _) in columns.items()))
