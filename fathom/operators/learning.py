"""Penalised, count and multi-class regression, trees and validation: data are read through aggregates, solves are small.

Every fit reads the rows a bounded number of times and brings sums over features (and bins) to the driver, never rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need, need_columns
from fathom.session import materialise


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray]:
    """n, means of xs, mean of y, covariance of xs, covariances with y: population forms, one aggregate; null rows left out."""
    need_columns(df, y, *xs)
    d = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate([*xs, y]))).dropna()
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p + 1)]
    got = d.agg(F.count("*"), *(F.avg(f"x{k}") for k in range(p + 1)), *(F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs)).first()
    n, mean = got[0], np.array([np.nan if v is None else v for v in got[1 : p + 2]], float)
    a, b = np.zeros((p, p)), np.zeros(p)
    for (i, j), v in zip(pairs, got[p + 2 :], strict=True):
        if j == p:
            b[i] = v or 0.0
        else:
            a[i, j] = a[j, i] = v or 0.0
    return n, mean[:p], float(mean[p]), a, b


def _terms(df: DataFrame, names: list[str], values: list[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, float(b)) for a, b in zip(names, values, strict=True)], "term string, coefficient double")


def elastic_net(df: DataFrame, y: str, xs: list[str], penalty: float, l1: float = 1.0, rounds: int = 10_000, tol: float = 1e-12) -> DataFrame:
    """(term, coefficient) minimising mean squared error / 2 + penalty * (l1 * |b| + (1 - l1) / 2 * b^2); l1 = 1 is the lasso.

    Coordinate descent runs on the covariances, so the data are read once whatever the number of rounds. The intercept
    is not penalised; a constant feature gets 0.
    """
    need(penalty >= 0 and 0 <= l1 <= 1, "penalty >= 0 and l1 in [0, 1]")
    n, mx, my, a, b = gram(df, y, xs)
    if not n:
        return _terms(df, [], [])
    w = np.zeros(len(xs))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(xs)):
            if a[j, j] <= 0:
                continue
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = math.copysign(max(abs(rho) - penalty * l1, 0.0), rho) / (a[j, j] + penalty * (1 - l1))
            moved, w[j] = max(moved, abs(new - w[j]) * math.sqrt(a[j, j])), new
        if moved < tol:
            break
    return _terms(df, ["intercept", *xs], [my - w @ mx, *w])


def poisson_regression(df: DataFrame, y: str, xs: list[str], rounds: int = 30, tol: float = 1e-10) -> DataFrame:
    """(term, coefficient) of a log-linear count model by Newton steps, one aggregate a round, features standardised inside."""
    n, mx, my, a, _ = gram(df, y, xs)
    if not n or my <= 0:
        return _terms(df, [], [])
    sd = np.where(np.diag(a) > 0, np.sqrt(np.diag(a)), 1.0)
    d = df.select(*(((F.col(c).cast("double") - float(m)) / float(s)).alias(f"z{k + 1}") for k, (c, m, s) in enumerate(zip(xs, mx, sd, strict=True))), F.lit(1.0).alias("z0"), F.col(y).cast("double").alias("y")).dropna()
    p = len(xs) + 1
    w = np.array([math.log(my), *[0.0] * (p - 1)])
    for _ in range(rounds):
        mu = F.exp(sum((F.col(f"z{k}") * float(w[k]) for k in range(p)), F.lit(0.0)))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        got = d.withColumn("m", mu).agg(*(F.sum(F.col(f"z{k}") * (F.col("y") - F.col("m"))) for k in range(p)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("m")) for i, j in pairs)).first()
        h = np.zeros((p, p))
        for (i, j), v in zip(pairs, got[p:], strict=True):
            h[i, j] = h[j, i] = v
        step = np.linalg.lstsq(h, np.array(got[:p]), rcond=None)[0]
        w += step
        if np.abs(step).max() < tol:
            break
    b = w[1:] / sd
    return _terms(df, ["intercept", *xs], [w[0] - b @ mx, *b])


def softmax_fit(df: DataFrame, label: str, xs: list[str], classes: int = 64, rounds: int = 200, rate: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """(class, term, coefficient) of multinomial logistic regression: gradient steps, one aggregate a round.

    More than `classes` classes are refused, since the model has a row for each.
    """
    found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(classes + 1).collect()]
    need(len(found) <= classes, f"more than {classes} classes")
    m = df.agg(*(f(F.col(c).cast("double")) for c in xs for f in (F.avg, F.stddev_pop))).first()
    mean, sd = [m[2 * k] or 0.0 for k in range(len(xs))], [m[2 * k + 1] or 1.0 for k in range(len(xs))]
    z = [F.lit(1.0), *((F.col(c).cast("double") - mean[k]) / sd[k] for k, c in enumerate(xs))]
    d = df.select(*(c.alias(f"z{k}") for k, c in enumerate(z)), label).dropna()
    w = np.zeros((len(found), len(z)))
    for _ in range(rounds):
        scores = [sum((F.col(f"z{k}") * float(row[k]) for k in range(len(z))), F.lit(0.0)) for row in w]
        e = d.withColumn("_s", F.array(*scores)).withColumn("_m", F.array_max("_s"))
        e = e.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.col("_m"))))
        e = e.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x))
        gaps = [F.when(F.col(label) == c, 1.0).otherwise(0.0) - F.get("_e", F.lit(k)) / F.col("_t") for k, c in enumerate(found)]
        g = np.array(e.agg(*(F.avg(gap * F.col(f"z{k}")) for gap in gaps for k in range(len(z)))).first(), float).reshape(w.shape)
        w += rate * g
        if np.abs(g).max() < tol:
            break
    rows = []
    for c, row in zip(found, w, strict=True):
        b = row[1:] / np.array(sd)
        rows += [(c, t, float(v)) for t, v in zip(["intercept", *xs], [row[0] - b @ np.array(mean), *b], strict=True)]
    return df.sparkSession.createDataFrame(rows, f"`class` {df.schema[label].dataType.simpleString()}, term string, coefficient double")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """(power, coefficient) of least squares in powers of x, solved on x shifted and scaled to stay well conditioned."""
    m = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if m[0] is None:
        return df.sparkSession.createDataFrame([], "power int, coefficient double")
    mean, sd = float(m[0]), float(m[1] or 1.0)
    z = (F.col(x) - mean) / sd
    d = df.select(*(F.pow(z, F.lit(float(k))).alias(f"_{k}") for k in range(1, degree + 1)), F.col(y).cast("double").alias("_y"))
    _, mx, my, a, b = gram(d, "_y", [f"_{k}" for k in range(1, degree + 1)])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    out, power = np.zeros(degree + 1), np.array([1.0])
    out[0] = my - w @ mx
    for c in w:
        power = np.convolve(power, [-mean / sd, 1 / sd])
        out[: len(power)] += c * power
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(out)], "power int, coefficient double")


def naive_bayes_predict(df: DataFrame, model: DataFrame, id: str, label: str, xs: list[str]) -> DataFrame:
    """(id, predicted) from a fitted model; classes with zero variance in a feature get a small one; ties to the smaller label.

    The model has a row a class and feature: it is collected and becomes part of the expression.
    """
    rows: dict = {}
    for r in model.collect():
        rows.setdefault(r[label], {"prior": r["prior"]})[r["feature"]] = (r["mean"], max(r["variance"] or 0.0, 1e-9))
    need(0 < len(rows) <= 1000, "between 1 and 1000 classes")
    scored = []
    for c in sorted(rows):
        s = F.lit(math.log(rows[c]["prior"]))
        for x in xs:
            m, v = rows[c][x]
            s = s - 0.5 * math.log(2 * math.pi * v) - (F.col(x) - m) * (F.col(x) - m) / (2 * v)
        scored.append(F.struct(s.alias("s"), F.lit(c).alias("c")))
    best = F.reduce(F.array(*scored[1:]), scored[0], lambda a, b: F.when(b.s > a.s, b).otherwise(a)) if len(scored) > 1 else scored[0]
    return df.select(id, best.c.alias("predicted"))


def fold(key: Column, k: int, seed: int = 0) -> Column:
    """Fold of a row by its key: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def cross_validated_mse(df: DataFrame, y: str, xs: list[str], key: str, k: int = 5, ridge: float = 0.0) -> DataFrame:
    """(fold, n, mse) of least squares. One grouped aggregate gives every fold's sums; a fold's model uses all others'."""
    names = [*xs, y]
    d = df.select(fold(F.col(key), k).alias("fold"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names))).dropna()
    p = len(xs)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    centre = [v or 0.0 for v in d.agg(*(F.avg(f"x{i}") for i in range(p + 1))).first()]
    c = [F.col(f"x{i}") - centre[i] for i in range(p + 1)]
    sums = d.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(c)), *(F.sum(c[i] * c[j]).alias(f"q{i}_{j}") for i, j in pairs)).collect()

    def moments(rows):
        q = np.zeros((p + 2, p + 2))
        for r in rows:
            q[0, 0] += r.n
            for i in range(p + 1):
                q[0, i + 1] += r[f"s{i}"]
                q[i + 1, 0] += r[f"s{i}"]
            for i, j in pairs:
                q[i + 1, j + 1] += r[f"q{i}_{j}"]
                if i != j:
                    q[j + 1, i + 1] += r[f"q{i}_{j}"]
        return q

    out = []
    for r in sums:
        q, held = moments([s for s in sums if s.fold != r.fold]), moments([r])
        penalty = np.diag([0.0, *[ridge] * p])
        w = np.linalg.lstsq(q[: p + 1, : p + 1] + penalty, q[: p + 1, p + 1], rcond=None)[0]
        v = np.append(-w, 1.0)
        out.append((r.fold, r.n, float(v @ held @ v / r.n)))
    return df.sparkSession.createDataFrame(out, "fold int, n long, mse double")


def decision_tree(df: DataFrame, label: str, xs: list[str], depth: int = 3, bins: int = 32, least: int = 2) -> DataFrame:
    """(node, feature, threshold, predicted, n): a Gini tree grown level by level; children of node i are 2i and 2i + 1.

    A level is one aggregate: counts by node, feature, bin and class, with bin edges from approximate quantiles taken once.
    What reaches the driver is bounded by 2^depth nodes x features x bins x classes.
    """
    d = df.select(*(F.col(c).cast("double").alias(c) for c in xs), label).dropna()
    cuts = d.approxQuantile(xs, [(k + 1) / (bins + 1) for k in range(bins)], 1e-3)
    edges = [sorted(set(c)) for c in cuts]

    def bin_of(c: str, ed: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, ed)), lambda e: F.col(c) > e))

    place = [bin_of(c, ed) for c, ed in zip(xs, edges, strict=True)]
    d = materialise(d.select(label, *(b.cast("int").alias(f"b{k}") for k, b in enumerate(place))), "bins")
    splits: dict[int, tuple[int, int]] = {}
    out, live = [], [1]
    for level in range(depth + 1):
        node = F.lit(1)
        for _ in range(level):
            go = F.lit(None).cast("int")
            for i, (f, b) in splits.items():
                go = F.when(node == i, F.when(F.col(f"b{f}") <= b, 2 * i).otherwise(2 * i + 1)).otherwise(go)
            node = F.when(node.isNull(), node).otherwise(go)
        x = d.withColumn("node", node).where(F.col("node").isNotNull())
        long = x.select("node", label, F.posexplode(F.array(*(f"b{k}" for k in range(len(xs))))).alias("feature", "bin"))
        counts = long.groupBy("node", "feature", "bin", label).agg(F.count("*").alias("n")).collect()
        by_node: dict[int, list] = {}
        for r in counts:
            by_node.setdefault(r.node, []).append(r)
        live = sorted(by_node)
        for i in live:
            classes = sorted({r[label] for r in by_node[i]})
            at = {c: k for k, c in enumerate(classes)}
            table = np.zeros((len(xs), bins + 1, len(classes)))
            for r in by_node[i]:
                table[r.feature, r.bin, at[r[label]]] += r.n
            total = table[0].sum(axis=0)
            n = total.sum()
            best = None
            for f in range(len(xs)):
                left = table[f].cumsum(axis=0)
                for b in range(len(edges[f])):
                    nl, nr = left[b].sum(), n - left[b].sum()
                    if min(nl, nr) < least:
                        continue
                    cost = nl - (left[b] ** 2).sum() / nl + nr - ((total - left[b]) ** 2).sum() / nr
                    if best is None or cost < best[0] - 1e-9:
                        best = (cost, f, b)
            grow = best is not None and level < depth and best[0] < n - (total**2).sum() / n - 1e-9
            if grow:
                splits[i] = best[1:]
            out.append((i, xs[best[1]] if grow else None, float(edges[best[1]][best[2]]) if grow else None, classes[int(total.argmax())], int(n)))
        if not any(i in splits for i in live):
            break
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"node int, feature string, threshold double, predicted {kind}, n long")


def tree_predict(df: DataFrame, tree: DataFrame) -> Column:
    """The tree as one expression over the features' columns."""
    rows = {r.node: r for r in tree.collect()}

    def at(i: int) -> Column:
        r = rows[i]
        return F.lit(r.predicted) if r.feature is None else F.when(F.col(r.feature) <= r.threshold, at(2 * i)).otherwise(at(2 * i + 1))

    return at(1)


def fisher_exact(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n11, n10, n01, n00, p_value): two-sided, sum of the tables no likelier than the one seen."""
    r = df.agg(*(F.sum(F.when(x & y, 1).otherwise(0)) for x in (a, ~a) for y in (b, ~b))).first()
    n11, n10, n01, n00 = (int(v or 0) for v in r)
    row, col, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    lg = math.lgamma
    top = lambda k: -(lg(k + 1) + lg(row - k + 1) + lg(col - k + 1) + lg(n - row - col + k + 1))
    logs = [top(k) for k in range(max(0, row + col - n), min(row, col) + 1)]
    peak = max(logs)
    weights, seen = [math.exp(x - peak) for x in logs], math.exp(top(n11) - peak)
    p = sum(w for w in weights if w <= seen * (1 + 1e-7)) / sum(weights)
    return df.sparkSession.createDataFrame([(n11, n10, n01, n00, min(1.0, p))], "n11 long, n10 long, n01 long, n00 long, p_value double")


def ks_one_sample(df: DataFrame, value: str, cdf) -> DataFrame:
    """(d, n): largest gap between the distribution of values and a column function; ties are taken at once.

    The running count over distinct values works in two steps, so that no one task sees them all: counts of 1,024 value
    ranges first, a window inside a range then.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    m = g.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    if m[2] is None:
        return df.sparkSession.createDataFrame([], "d double, n long")
    lo, width, n = m[0], (m[1] - m[0]) / 1024 or 1.0, m[2]
    g = g.withColumn("_b", F.least(F.floor((F.col("v") - lo) / width), F.lit(1023)).cast("int"))
    below = g.groupBy("_b").agg(F.sum("c").alias("c")).withColumn("_before", F.sum("c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    x = g.join(F.broadcast(below), "_b")  # at most 1,024 rows
    upto = F.col("_before") + F.sum("c").over(W.partitionBy("_b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    x = x.select("v", "c", upto.alias("u")).withColumn("f", cdf(F.col("v")))
    gap = F.greatest(F.abs(F.col("u") / n - F.col("f")), F.abs((F.col("u") - F.col("c")) / n - F.col("f")))
    return x.agg(F.max(gap).alias("d"), F.sum("c").alias("n"))
