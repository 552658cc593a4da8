"""Regression from sums of products, classification metrics, naive Bayes and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need_columns
from fathom.functions.columns import nonzero
from fathom.operators.running import running
from fathom.session import ship, spread


def linear_model(df: DataFrame, y: str, xs: list[str], weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """(term, coefficient) of ordinary, weighted or ridge least squares, from one aggregate of centred, scaled products.

    The intercept is not penalised. Rows with a null are left out. The solve is (p, p) on the driver.
    """
    need_columns(df, y, *xs)
    w = F.lit(1.0) if weight is None else weight
    d = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate([*xs, y])), w.cast("double").alias("w")).dropna()
    n = len(xs)
    sums = d.agg(F.sum("w"), *(F.sum(F.col("w") * F.col(f"x{k}")) for k in range(n + 1))).first()
    if not sums[0]:
        return df.sparkSession.createDataFrame([], "term string, coefficient double")
    mean = [s / sums[0] for s in sums[1:]]
    c = [F.col(f"x{k}") - F.lit(mean[k]) for k in range(n + 1)]
    pairs = [(i, j) for i in range(n) for j in range(i, n + 1)]
    got = d.agg(*(F.sum(F.col("w") * c[i] * c[j]) for i, j in pairs)).first()
    a, b = np.zeros((n, n)), np.zeros(n)
    for (i, j), v in zip(pairs, got, strict=True):
        if j == n:
            b[i] = v
        else:
            a[i, j] = a[j, i] = v
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.lstsq((a + ridge * np.eye(n)) / np.outer(scale, scale), b / scale, rcond=None)[0] / scale
    rows = [("intercept", float(mean[n] - beta @ np.array(mean[:n]))), *zip(xs, beta.tolist(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def regression_metrics(df: DataFrame, y: str, predicted: Column) -> DataFrame:
    e = F.col(y) - predicted
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where a denominator is 0."""
    c = confusion(df, actual, predicted)
    both = c.select(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("said"), F.col("n").alias("is")).union(c.select("predicted", F.lit(0), "n", F.lit(0)))
    g = both.groupBy("class").agg(*(F.sum(x).alias(x) for x in ("tp", "said", "is")))
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("is") > 0, F.col("tp") / F.col("is")).otherwise(0.0)
    return g.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.col("is").alias("support"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks over distinct scores."""
    g = df.groupBy(score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    g = running(g, [score], upto=("sum", F.col("n")))
    t = g.withColumn("r", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).agg(F.sum(F.col("r") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def naive_bayes_fit(df: DataFrame, label: str, xs: list[str]) -> DataFrame:
    """(label, feature, prior, mean, variance) of Gaussian naive Bayes, from one grouped aggregate."""
    g = df.groupBy(label).agg(F.count("*").alias("n"), *(x for c in xs for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))))
    g = g.withColumn("prior", F.col("n") / F.sum("n").over(W.partitionBy()))
    return g.select(label, "prior", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"v_{c}").alias("variance")) for c in xs))).alias("x")).select(label, "x.feature", "prior", "x.mean", "x.variance")


def logistic(df: DataFrame, y: str, xs: list[str], rounds: int = 25, tol: float = 1e-10) -> DataFrame:
    """(term, coefficient) of logistic regression by Newton steps, one aggregate a round; features are standardised inside."""
    d = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(xs)), (F.col(y) > 0).cast("double").alias("y")).dropna()
    m = d.agg(*(f(f"x{k}") for k in range(len(xs)) for f in (F.avg, F.stddev_pop))).first()
    z = [F.lit(1.0), *((F.col(f"x{k}") - m[2 * k]) / (m[2 * k + 1] or 1.0) for k in range(len(xs)))]
    n = len(z)
    w = np.zeros(n)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((z[k] * float(w[k]) for k in range(n)), F.lit(0.0))))
        got = d.withColumn("p", p).agg(*(F.sum(z[k] * (F.col("y") - F.col("p"))) for k in range(n)), *(F.sum(z[i] * z[j] * F.col("p") * (1 - F.col("p"))) for i in range(n) for j in range(n))).first()
        step = np.linalg.lstsq(np.array(got[n:]).reshape(n, n), np.array(got[:n]), rcond=None)[0]
        w += step
        if np.abs(step).max() < tol:
            break
    beta = [w[k + 1] / (m[2 * k + 1] or 1.0) for k in range(len(xs))]
    return df.sparkSession.createDataFrame([("intercept", float(w[0] - sum(b * m[2 * k] for k, b in enumerate(beta)))), *((c, float(b)) for c, b in zip(xs, beta, strict=True))], "term string, coefficient double")


def knn(points: DataFrame, queries: DataFrame, id: str, vector: str, label: str, k: int, most_queries: int = 50_000) -> DataFrame:
    """Majority label of the k nearest points (squared distance, ties to smaller ids and labels). Queries are broadcast in
    blocks of about most_queries, each exact by itself; queries that share an id are in one block. A distance from or to a
    vector that is null, holds what is null or not finite, or has another length than the query comes last.

    A task takes its points in Arrow batches: matrix products give distances but for rounding, those that rounding could bring
    among the nearest are worked out term by term, and the task keeps the k nearest of each query.
    """
    ship(points.sparkSession)
    asked = queries.select(F.col(id).alias("q_id"), F.col(vector).cast("array<double>").alias("_q"))
    kinds = {c: points.schema[c].dataType.simpleString() for c in (id, label)}
    x = spread(points.select(id, label, F.col(vector).cast("array<double>").alias("_x")), id)
    blocks = max(1, -(-asked.count() // most_queries))
    answers = []
    for block in range(blocks):
        q = (asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()
        sent = points.sparkSession.sparkContext.broadcast(q)
        run = partial(_nearest, sent=sent, k=k, names=("q_id", id, label))
        answers.append(x.mapInArrow(run, f"q_id {kinds[id]}, `{id}` {kinds[id]}, `{label}` {kinds[label]}, d double"))
    near = reduce(DataFrame.union, answers)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy("d", id))).where(F.col("r") <= k)
    votes = near.groupBy("q_id", label).agg(F.count("*").alias("votes"))
    return votes.groupBy("q_id").agg(F.max_by(label, F.struct("votes", -F.col(label))).alias("predicted"))


def _vectors(c: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length that hold finite numbers."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    starts, values = c.offsets.to_numpy()[:-1], c.values.to_numpy(zero_copy_only=False)
    lengths = np.where(c.is_valid().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()), -1)
    out = []
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        m = values[starts[at][:, None] + np.arange(n)].astype(float)
        fine = np.isfinite(m).all(1)
        out.append((n, at[fine], m[fine]))
    return out


def _keys(c: pa.Array) -> np.ndarray:
    x = c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _nearest(batches: Iterator[pa.RecordBatch], sent, k: int, names: tuple[str, str, str], block: int = 256) -> Iterator[pa.RecordBatch]:
    q = sent.value
    if not q.num_rows:
        return
    q_keys, q_ids, q_vectors = _keys(q["q_id"]), q["q_id"].combine_chunks(), _vectors(q["_q"])
    # of the nearest up to now: query, distance, key; ids and labels in Arrow
    of, far, keys, ids, labels = np.zeros(0, int), np.zeros(0), None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        n, key = b.num_rows, _keys(b.column(0))
        groups = {length: (at, m, (m * m).sum(1)) for length, at, m in _vectors(b.column(2))}
        found = []
        for length, rows, m in [*q_vectors, (-1, np.setdiff1d(np.arange(q.num_rows), np.concatenate([r for _, r, _ in q_vectors] or [np.zeros(0, int)])), None)]:
            at, x, xx = groups.get(length, (np.zeros(0, int), None, None))
            for start in range(0, len(rows), block):
                r = rows[start : start + block]
                d, slack = np.full((len(r), n), np.inf), np.zeros(len(r))
                if len(at):
                    y = m[start : start + block]
                    yy = (y * y).sum(1)
                    d[:, at] = yy[:, None] + xx - 2 * (y @ x.T)
                    slack = 16 * (length + 8) * np.finfo(float).eps * (np.sqrt(xx.max()) + np.sqrt(yy)) ** 2
                d[q_keys[r][:, None] == key] = np.nan
                least = np.partition(d, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                i, j = np.nonzero(d <= (np.where(np.isnan(least), np.inf, least) + slack)[:, None])
                exact = d[i, j]
                place = np.full(n, -1)
                place[at] = np.arange(len(at))
                held = place[j] >= 0
                if held.any():
                    s = np.zeros(int(held.sum()))
                    u, v = y[i[held]], x[place[j[held]]]
                    for c in range(length):
                        s = s + (u[:, c] - v[:, c]) * (u[:, c] - v[:, c])
                    exact[held] = s
                found.append((r[i], exact, j))
        j = np.concatenate([f[2] for f in found])
        take = pa.array(j)
        of, far = np.concatenate([of, *(f[0] for f in found)]), np.concatenate([far, *(f[1] for f in found)])
        keys = key[j] if keys is None else np.concatenate([keys, key[j]])
        ids = b.column(0).take(take) if ids is None else pa.concat_arrays([ids, b.column(0).take(take)])
        labels = b.column(1).take(take) if labels is None else pa.concat_arrays([labels, b.column(1).take(take)])
        order = np.lexsort((keys, far, of))
        first = np.searchsorted(of[order], of[order])
        order = order[np.arange(len(order)) - first < k]
        of, far, keys, ids, labels = of[order], far[order], keys[order], ids.take(pa.array(order)), labels.take(pa.array(order))
    for start in range(0, len(of), 10_000):
        n = slice(start, start + 10_000)
        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(of[n])), ids[n], labels[n], pa.array(far[n])], names=[*names, "d"])


def linear_prediction(intercept: float, weights: dict[str, float]) -> Column:
    out = F.lit(float(intercept))
    for c, w in weights.items():
        out = out + float(w) * F.col(c)
    return out


def logistic_probability(intercept: float, weights: dict[str, float]) -> Column:
    return 1 / (1 + F.exp(-linear_prediction(intercept, weights)))


def logistic_class(intercept: float, weights: dict[str, float], threshold: float = 0.5) -> Column:
    return (logistic_probability(intercept, weights) >= threshold).cast("int")


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of rows where both agree, of those that have both."""
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"))


def log_loss(df: DataFrame, label: str, probability: Column, least: float = 1e-15) -> DataFrame:
    """Mean of -ln of the probability given to what happened, kept away from 0 and 1 by `least`."""
    p = F.greatest(F.least(probability, F.lit(1 - least)), F.lit(least))
    return df.agg(F.avg(-F.when(F.col(label) > 0, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean of the classes' F1."""
    return class_report(df, actual, predicted).agg(F.avg("f1").alias("macro_f1"))


def information_criteria(df: DataFrame, residual: str, parameters: int) -> DataFrame:
    """Gaussian log-likelihood of residuals at their own variance, with Akaike's and Schwarz's criteria."""
    n, v = F.count(residual), F.avg(F.col(residual) * F.col(residual))
    g = df.agg(n.cast("double").alias("n"), v.alias("v"))
    ll = -F.col("n") / 2 * (F.log(2 * math.pi * nonzero(F.col("v"))) + 1)
    return g.select(ll.alias("log_likelihood"), (2 * parameters - 2 * ll).alias("aic"), (parameters * F.log("n") - 2 * ll).alias("bic"))
