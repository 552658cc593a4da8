"""Time series: windows by series key, ordered by time and a unique tie-break; recursions run once a key in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need, need_columns
from fathom.functions.columns import nonzero
from fathom.session import ship


def ordered(by: list[str], order: list[str]) -> W:
    return W.partitionBy(*by).orderBy(*order)


def sma(df: DataFrame, value: str, by: list[str], order: list[str], width: int) -> DataFrame:
    """Rows with a full trailing window, with its mean as `sma`."""
    need(width >= 1, "width is at least 1")
    need_columns(df, value, *by, *order)
    w = ordered(by, order)
    x = df.withColumn("sma", F.avg(value).over(w.rowsBetween(1 - width, 0))).withColumn("_n", F.row_number().over(w))
    return x.where(F.col("_n") >= width).drop("_n")


def difference(df: DataFrame, value: str, by: list[str], order: list[str], lag: int = 1) -> DataFrame:
    """Rows with a predecessor lag rows back, with value - predecessor as `diff`."""
    return df.withColumn("diff", F.col(value) - F.lag(value, lag).over(ordered(by, order))).where("diff is not null")


def moving_average_residuals(df: DataFrame, value: str, by: list[str], order: list[str], width: int) -> DataFrame:
    """value less the mean of its trailing window, shorter at the start."""
    return df.withColumn("residual", F.col(value) - F.avg(value).over(ordered(by, order).rowsBetween(1 - width, 0)))


def rolling_z(df: DataFrame, value: str, by: list[str], order: list[str], width: int, limit: float) -> DataFrame:
    """z of a value against the full trailing window that ends with it, and whether it passes the limit."""
    w = ordered(by, order)
    r = w.rowsBetween(1 - width, 0)
    x = df.withColumn("_sd", F.stddev_samp(value).over(r)).withColumn("_m", F.avg(value).over(r)).withColumn("_n", F.row_number().over(w))
    x = x.where(F.col("_n") >= width).withColumn("z", F.when(F.col("_sd") > 0, (F.col(value) - F.col("_m")) / F.col("_sd")).otherwise(0.0))
    return x.withColumn("anomaly", F.abs("z") > limit).drop("_sd", "_m", "_n")


def acf(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """Autocorrelation r_1..r_lags of each series: lagged products about the series' mean over its sum of squares."""
    w = ordered(by, order)
    x = df.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    x = x.select(*by, "_d", *(F.lag("_d", k).over(w).alias(f"_{k}") for k in range(1, lags + 1)))
    g = x.groupBy(*by).agg(F.count("*").alias("n"), *((F.sum(F.col("_d") * F.col(f"_{k}")) / nonzero(F.sum(F.col("_d") * F.col("_d")))).alias(f"r{k}") for k in range(1, lags + 1)))
    return g.select(*by, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)))).alias("x")).select(*by, "n", "x.lag", "x.r")


def ljung_box(df: DataFrame, value: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    a = acf(df, value, by, order, lags)
    return a.groupBy(*by).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("r") * F.col("r") / nonzero(F.col("n") - F.col("lag")))).alias("q"), F.lit(lags).alias("df"))


def ccf(df: DataFrame, x: str, y: str, by: list[str], order: list[str], lag: int) -> DataFrame:
    """Correlation of x with y lag rows later, about whole-series means and deviations."""
    w, all_ = ordered(by, order), W.partitionBy(*by)
    d = df.select(*by, (F.col(x) - F.avg(x).over(all_)).alias("_x"), F.lead(F.col(y), lag).over(w).alias("_l"), F.avg(y).over(all_).alias("_my"), (F.col(y) - F.avg(y).over(all_)).alias("_y"))
    return d.groupBy(*by).agg((F.sum(F.col("_x") * (F.col("_l") - F.col("_my"))) / nonzero(F.sqrt(F.sum(F.col("_x") * F.col("_x")) * F.sum(F.col("_y") * F.col("_y"))))).alias("ccf"))


def change_point(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """The first place where the cumulative sum of deviations from the mean is farthest from zero."""
    w = ordered(by, order)
    x = df.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    x = x.select(*by, F.row_number().over(w).alias("position"), F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cusum"))
    return x.groupBy(*by).agg(F.min_by("position", F.struct(-F.round(F.abs("cusum"), 9), F.col("position"))).alias("position"), F.max(F.abs("cusum")).alias("cusum"))


def drift_forecast(df: DataFrame, value: str, by: list[str], order: list[str], steps: int) -> DataFrame:
    """last + h * (last - first) / (n - 1) for h = 1..steps, and the naive forecast (last)."""
    g = df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias("a"), F.max_by(value, F.struct(*order)).alias("z"), F.count("*").alias("n")).where("n > 1")
    return g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(*by, "h", (F.col("z") + F.col("h") * (F.col("z") - F.col("a")) / (F.col("n") - 1)).alias("drift"), F.col("z").alias("naive"))


def forecast_metrics(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col(actual) != 0, F.abs(e / F.col(actual))) * 100).alias("mape"))


def decompose_additive(df: DataFrame, value: str, by: list[str], order: list[str], period: int) -> DataFrame:
    """Centred moving-average trend (odd period), seasonal means of the detrended values, remainder."""
    need(period % 2 == 1, "an odd period")
    w, h = ordered(by, order), period // 2
    x = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_t", F.avg(value).over(w.rowsBetween(-h, h))).withColumn("_c", F.count(value).over(w.rowsBetween(-h, h)))
    x = x.withColumn("trend", F.when(F.col("_c") == period, F.col("_t"))).withColumn("season", F.col("_n") % period)
    x = x.withColumn("seasonal", F.avg(F.col(value) - F.col("trend")).over(W.partitionBy(*by, "season")))
    return x.withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_n", "_t", "_c")


def recursion(df: DataFrame, value: str, by: list[str], order: list[str], key: list[str], out: str, step: Callable[[list[float]], list[float]]) -> DataFrame:
    """Applies a sequential recursion once a series: step(values in order) -> one output a value."""
    columns = list(dict.fromkeys([*by, *order, *key, value]))
    x = df.select(*columns).where(F.col(value).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[out] = step(pdf[value].astype(float).tolist())
        return pdf

    return x.groupBy(*by).applyInPandas(run, f"{schema}, `{out}` double")


def carried(df: DataFrame, value: str, by: list[str], order: list[str], key: list[str], out: str, start: Callable[[], Callable[[float], float]]) -> DataFrame:
    """A recursion that needs its last state only: start() gives a function that is called with each value of a series in
    order. Series come sorted, in Arrow batches, so memory does not grow with their length. Nulls of order come last."""
    ship(df.sparkSession)
    columns = list(dict.fromkeys([*by, *order, *key, value]))
    x = df.select(*columns).where(F.col(value).isNotNull())
    x = (x.repartition(*by) if by else x.coalesce(1)).sortWithinPartitions(*by, *(F.col(c).asc_nulls_last() for c in order))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for b in batches:
            keys = list(zip(*(["nan" if k != k else k for k in b.column(c).to_pylist()] for c in by), strict=True)) if by else [()] * b.num_rows
            got = []
            for k, v in zip(keys, b.column(value).cast(pa.float64()).to_pylist(), strict=True):
                if step is None or k != at:
                    at, step = k, start()
                got.append(step(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return x.mapInArrow(run, f"{schema}, `{out}` double")


def ema(df: DataFrame, value: str, by: list[str], order: list[str], alpha: float, key: list[str] | None = None) -> DataFrame:
    """y_0 = x_0, y_t = alpha * x_t + (1 - alpha) * y_(t-1)."""
    need(0 < alpha <= 1, "alpha is in (0, 1]")

    def start():
        y = None

        def step(x: float) -> float:
            nonlocal y
            y = x if y is None else alpha * x + (1 - alpha) * y
            return y

        return step

    return carried(df, value, by, order, key or [], "ema", start)


def holt(df: DataFrame, value: str, by: list[str], order: list[str], alpha: float, beta: float, key: list[str] | None = None) -> DataFrame:
    """Level of Holt's linear smoothing: level_0 = x_0, trend_0 = x_1 - x_0."""

    def start():
        level = trend = None

        def step(x: float) -> float:
            nonlocal level, trend
            if level is None:
                level = x
                return level
            trend = x - level if trend is None else trend
            last, level = level, alpha * x + (1 - alpha) * (level + trend)
            trend = beta * (level - last) + (1 - beta) * trend
            return level

        return step

    return carried(df, value, by, order, key or [], "level", start)


def kalman_local_level(df: DataFrame, value: str, by: list[str], order: list[str], q: float, r: float, p0: float = 1.0, key: list[str] | None = None) -> DataFrame:
    """Filtered level of a random walk (variance q) seen through noise (variance r), from the first value."""

    def start():
        x, p = None, p0

        def step(z: float) -> float:
            nonlocal x, p
            if x is None:
                x = z
                return x
            p += q
            gain = p / (p + r)
            x += gain * (z - x)
            p *= 1 - gain
            return x

        return step

    return carried(df, value, by, order, key or [], "level", start)
