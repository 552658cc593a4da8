"""Streaming twins of ordered recursions: state a key, a watermark, late rows dropped.

The order column is event time. Rows of a key wait in state until the watermark passes them, so that a batch that arrives
out of order gives the same values as the ordered table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ema_stream(df: DataFrame, key: str, time: str, tie: str, value: str, alpha: float, delay: str = "10 minutes") -> DataFrame:
    """(key, time, tie, ema) of a stream; time is a timestamp, tie a unique long within equal times."""
    x = df.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value")).withWatermark("time", delay)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, ties, values = state.get if state.exists else (None, [], [], [])
        rows = list(zip(times, ties, values, strict=True))
        for b in batches:
            micros = b["time"].astype("int64") // (1 if str(b["time"].dtype).startswith("datetime64[us") else 1000)
            rows += list(zip(micros.tolist(), b["tie"].tolist(), b["value"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        rows.sort()
        ready = [r for r in rows if r[0] <= mark]
        rows = [r for r in rows if r[0] > mark]
        out = []
        for t, i, v in ready:
            last = v if last is None else alpha * v + (1 - alpha) * last
            out.append((k[0], pd.Timestamp(t, unit="us"), i, last))
        state.update((last, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "time", "tie", "ema"])

    return x.groupBy("key").applyInPandasWithState(run, "key string, time timestamp, tie long, ema double", "last double, times array<long>, ties array<long>, vals array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_stats(df: DataFrame, time: str, value: str, by: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding window aggregates with a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), *by, "n", "mean", "max")


def sessions(df: DataFrame, time: str, by: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Session windows with a watermark: (start, end, by.., n)."""
    return df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
