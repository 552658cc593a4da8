"""Descriptive statistics, hypothesis tests and rank statistics: one aggregate or window pass, then closed forms.

Statistics are native aggregates; p-values are made on the few result rows (fathom.functions.special). Nulls are ignored by
every statistic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need, need_columns
from fathom.functions.columns import nonzero
from fathom.operators.running import running
from fathom.session import discard, materialise, ship, unused


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, sample variance and deviation, minimum and maximum by group."""
    need_columns(df, value, *by)
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"))


def zscore(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds z = (value - mean) / sample deviation within the group; null where the deviation is 0."""
    need_columns(df, value, *by)
    w = W.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def moments(df: DataFrame, columns: list[str], corr: bool = False) -> DataFrame:
    """Covariance (or correlation) matrix in long form (i, j, v), from one aggregate."""
    need_columns(df, *columns)
    f = F.corr if corr else F.covar_samp
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(f(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"_{k}").alias("v")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line: slope, intercept, r2, residual standard error, standard error of the slope, t of the slope, n."""
    need_columns(df, x, y)
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    a = a.withColumn("residual_se", F.sqrt((1 - F.col("r2")) * F.col("syy") / nonzero(F.col("n") - 2)))
    a = a.withColumn("slope_se", F.col("residual_se") / nonzero(F.sqrt("sxx")))
    return a.select("slope", "intercept", "r2", "residual_se", "slope_se", (F.col("slope") / nonzero(F.col("slope_se"))).alias("t"), "n")


def _groups(df: DataFrame, value: str, by: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def anova(df: DataFrame, value: str, by: str) -> DataFrame:
    """One-way analysis of variance: f_statistic, df_between, df_within, ss_between, ss_within. Null F where it is undefined."""
    need_columns(df, value, by)
    g = _groups(df, value, by)
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"))
    t = t.withColumn("ss_between", F.col("s2") - F.col("s1") * F.col("s1") / F.col("nn"))
    ok = (F.col("k") >= 2) & (F.col("nn") > F.col("k")) & (F.col("ss_within") > 0)
    f = F.when(ok, (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("nn") - F.col("k"))))
    return t.select(f.alias("f_statistic"), (F.col("k") - 1).cast("long").alias("df_between"), (F.col("nn") - F.col("k")).cast("long").alias("df_within"), "ss_between", "ss_within")


def medians(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, median), by counts of distinct values and their running totals: no task holds a group's values. Null groups are left out."""
    x = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    x = materialise(running(x, ["_g", "_v"], _upto=("sum", F.col("_n"))))
    # ranks of the two middle rows among all rows
    g = x.groupBy("_g").agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))
    g = g.select("_g", *((F.col("_before") + F.floor((F.col("_all") + k) / 2)).alias(f"_r{k}") for k in (1, 2)))
    at = lambda r: F.max(F.when((F.col("_upto") >= F.col(r)) & (F.col("_upto") - F.col("_n") < F.col(r)), F.col("_v")))
    out = materialise(x.join(g, "_g").groupBy(F.col("_g").alias(by)).agg(((at("_r1") + at("_r2")) / 2).alias("median")))
    discard(x)
    return out


def levene(df: DataFrame, value: str, by: str, center: str = "median") -> DataFrame:
    """ANOVA of absolute deviations from the group's median (or mean). The group's centre is an aggregate joined back."""
    need(center in ("mean", "median"), "center is mean or median")
    c = medians(df, value, by).withColumnRenamed("median", "_c") if center == "median" else df.groupBy(by).agg(F.avg(value).alias("_c"))
    return anova(df.join(c, by).select(by, F.abs(F.col(value) - F.col("_c")).alias("_d")), "_d", by).select(F.col("f_statistic").alias("w_statistic"), "df_between", "df_within")


def tukey_pairs(df: DataFrame, value: str, by: str) -> DataFrame:
    """Pairwise mean differences with q = |difference| / sqrt(MSW / 2 * (1/n1 + 1/n2)). Groups, not rows, are paired."""
    g = _groups(df, value, by)
    msw = g.agg((F.sum((F.col("n") - 1) * F.col("v")) / nonzero(F.sum("n") - F.count("*"))).alias("msw"))
    a, b = g.select(F.col(by).alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1")), g.select(F.col(by).alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    p = a.join(b, F.col("a") < F.col("b")).join(F.broadcast(msw))  # one row a group on either side
    return p.select("a", "b", (F.col("m1") - F.col("m2")).alias("difference"), (F.abs(F.col("m1") - F.col("m2")) / nonzero(F.sqrt(F.col("msw") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))).alias("q"))


def t_one_sample(df: DataFrame, value: str, mu: float) -> DataFrame:
    a = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    return a.select(((F.col("m") - mu) / nonzero(F.col("s") / nonzero(F.sqrt("n")))).alias("t"), (F.col("n") - 1).alias("df"))


def t_two_sample(df: DataFrame, value: str, by: str, first, second, pooled: bool) -> DataFrame:
    """Pooled or Welch t of the groups where by is first and second."""
    def s(which):
        v = F.when(F.col(by) == which, F.col(value))
        return F.avg(v), F.var_samp(v), F.count(v)

    (m1, v1, n1), (m2, v2, n2) = s(first), s(second)
    a = df.agg(m1.alias("m1"), v1.alias("v1"), n1.alias("n1"), m2.alias("m2"), v2.alias("v2"), n2.alias("n2"))
    c = {k: F.col(k) for k in ("m1", "v1", "n1", "m2", "v2", "n2")}
    if pooled:
        dof = (c["n1"] + c["n2"] - 2).cast("double")
        se = F.sqrt(((c["n1"] - 1) * c["v1"] + (c["n2"] - 1) * c["v2"]) / nonzero(dof) * (1 / nonzero(c["n1"]) + 1 / nonzero(c["n2"])))
    else:
        a1, a2 = c["v1"] / c["n1"], c["v2"] / c["n2"]
        dof, se = (a1 + a2) * (a1 + a2) / nonzero(a1 * a1 / nonzero(c["n1"] - 1) + a2 * a2 / nonzero(c["n2"] - 1)), F.sqrt(a1 + a2)
    return a.select(((c["m1"] - c["m2"]) / nonzero(se)).alias("t"), dof.alias("df"))


def t_paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return t_one_sample(df.select((F.col(x) - F.col(y)).alias("_d")), "_d", 0.0)


def z_two_proportion(df: DataFrame, by: str, first, second, success: Column) -> DataFrame:
    def s(which):
        k = F.col(by) == which
        return F.sum(F.when(k & success, 1).otherwise(0)), F.sum(F.when(k, 1).otherwise(0))

    (x1, n1), (x2, n2) = s(first), s(second)
    a = df.agg(x1.alias("x1"), n1.alias("n1"), x2.alias("x2"), n2.alias("n2"))
    p = (F.col("x1") + F.col("x2")) / nonzero(F.col("n1") + F.col("n2"))
    p1, p2 = F.col("x1") / nonzero(F.col("n1")), F.col("x2") / nonzero(F.col("n2"))
    return a.select(((p1 - p2) / nonzero(F.sqrt(p * (1 - p) * (1 / nonzero(F.col("n1")) + 1 / nonzero(F.col("n2")))))).alias("z"), p1.alias("p1"), p2.alias("p2"))


def chi2_gof(df: DataFrame, by: str) -> DataFrame:
    """Goodness of fit against equal frequencies."""
    g = df.groupBy(by).count()
    t = g.agg(F.sum("count").alias("n"), F.count("*").alias("k"), F.sum(F.col("count") * F.col("count")).alias("s"))
    return t.select((F.col("s") * F.col("k") / nonzero(F.col("n")) - F.col("n")).alias("chi2"), (F.col("k") - 1).alias("df"))


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    g = df.groupBy(a, b).count()
    r, c = g.groupBy(a).agg(F.sum("count").alias("_r")), g.groupBy(b).agg(F.sum("count").alias("_c"))
    j = g.join(r, a).join(c, b)
    t = j.agg(F.sum(F.col("count") * F.col("count") / (F.col("_r") * F.col("_c"))).alias("s"), F.sum("count").alias("n"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return t.select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.sqrt((F.col("s") - 1) / nonzero(F.least(F.col("ka") - 1, F.col("kb") - 1))).alias("cramers_v"))


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, times, mid_rank): mid-ranks from counts of distinct values, so that the running sum orders distinct values only."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("times"))
    g = running(g, [value], upto=("sum", F.col("times")))
    return g.select(value, "times", (F.col("upto") - F.col("times") + (F.col("times") + 1) / 2.0).alias("mid_rank"))


def mann_whitney(df: DataFrame, value: str, by: str, first, second) -> DataFrame:
    """U of the first group, its mean and tie-corrected deviation, and z."""
    d = df.where(F.col(by).isin(first, second))
    r = value_ranks(d, value)
    a = d.join(r, value).agg(F.sum(F.when(F.col(by) == first, F.col("mid_rank"))).alias("r1"), F.sum(F.when(F.col(by) == first, 1)).cast("double").alias("n1"), F.sum(F.when(F.col(by) == second, 1)).cast("double").alias("n2"))
    ties = r.agg(F.sum(F.col("times").cast("double") * F.col("times") * F.col("times") - F.col("times")).alias("ties"))
    x = a.join(F.broadcast(ties))  # one row each
    n = F.col("n1") + F.col("n2")
    u, mean = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / nonzero(n * (n - 1))))
    return x.select(u.alias("u1"), (F.col("n1") * F.col("n2") - u).alias("u2"), ((u - mean) / nonzero(sd)).alias("z"))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Signed ranks of non-zero differences: w_plus, w_minus, n."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    return d.join(value_ranks(d, "a"), "a").agg(F.sum(F.when(F.col("d") > 0, F.col("mid_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("mid_rank")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))


def kruskal(df: DataFrame, value: str, by: str) -> DataFrame:
    """H with tie correction, and degrees of freedom."""
    r = value_ranks(df, value)
    g = df.join(r, value).groupBy(by).agg(F.sum("mid_rank").alias("r"), F.count("*").cast("double").alias("n"))
    t = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = r.agg(F.sum(F.col("times").cast("double") * F.col("times") * F.col("times") - F.col("times")).alias("ties"))
    x = t.join(F.broadcast(ties))  # one row each
    n = F.col("n")
    h = (12 / nonzero(n * (n + 1)) * F.col("s") - 3 * (n + 1)) / nonzero(1 - F.col("ties") / nonzero(n * n * n - n))
    return x.select(h.alias("h"), (F.col("k") - 1).alias("df"))


def ks_two_sample(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """Largest difference of the two empirical distribution functions, over distinct values."""
    u = a.select(F.col(x).alias("v"), F.lit(1).alias("p"), F.lit(0).alias("q")).union(b.select(F.col(y).alias("v"), F.lit(0).alias("p"), F.lit(1).alias("q"))).where("v is not null")
    g = u.groupBy("v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    g = running(g, ["v"], f=("sum", F.col("p")), g=("sum", F.col("q")))
    n = g.agg(F.sum("p").alias("n1"), F.sum("q").alias("n2"))
    return g.join(F.broadcast(n)).groupBy("n1", "n2").agg(F.max(F.abs(F.col("f") / F.col("n1") - F.col("g") / F.col("n2"))).alias("d")).select("d", "n1", "n2")  # n: one row


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = value_ranks(d, x).select(x, F.col("mid_rank").alias("_rx")), value_ranks(d, y).select(y, F.col("mid_rank").alias("_ry"))
    return d.select(x, y).join(rx, x).join(ry, y).agg(F.corr("_rx", "_ry").alias("rho"))


#: Rows of a block in kendall, and blocks a side at most.
KENDALL_ROWS, KENDALL_BLOCKS = 1 << 17, 1024


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray, block: np.ndarray | None = None) -> int:
    """Sum of n_i n_j sign(y_j - y_i) over pairs with x_i < x_j, and in other blocks where blocks are given: counted by
    merging halves of the order of x, one bit of its rank at a time."""
    _, rx = np.unique(x, return_inverse=True)
    _, ry = np.unique(y, return_inverse=True)
    total = _merged(rx, ry, n)
    if block is not None:
        for k in np.unique(block).tolist():
            at = block == k
            total -= _merged(rx[at], ry[at], n[at])
    return total


def _merged(rx: np.ndarray, ry: np.ndarray, n: np.ndarray) -> int:
    total = 0
    for bit in range(int(rx.max(initial=0)).bit_length()):
        half, right = rx >> (bit + 1), (rx >> bit) & 1
        order = np.lexsort((ry, half))
        h, y, r, w = half[order], ry[order], right[order].astype(bool), n[order].astype(np.int64)
        left = np.concatenate([[0], np.cumsum(np.where(r, 0, w))])
        edge = np.ones(len(h), bool)
        edge[1:] = (h[1:] != h[:-1]) | (y[1:] != y[:-1])
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], len(h))
        run = np.cumsum(edge) - 1
        first = np.searchsorted(h, h, "left")
        last = np.searchsorted(h, h, "right")
        # for each member of the right half: weights of the left half below it, less those above it
        below, above = left[start[run]] - left[first], left[last] - left[stop[run]]
        total += int(((below - above) * w)[r].sum())
    return total


def kendall(df: DataFrame, x: str, y: str, rows: int = KENDALL_ROWS) -> DataFrame:
    """Kendall's tau-b over distinct pairs of values with their counts.

    Values are cut into ranges of x and ranges of y. Pairs that differ in both ranges are counted from the table of range
    sizes (at most KENDALL_BLOCKS a side); pairs within a range of x, and within a range of y but not of x, by one task a range.
    """
    spark = df.sparkSession
    ship(spark)
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    g = materialise(g, "pairs")
    m = g.count()
    cuts = min(KENDALL_BLOCKS, m // rows + 1)
    edges = g.approxQuantile(["x", "y"], [k / cuts for k in range(1, cuts)], 0.1 / cuts) if cuts > 1 else [[], []]
    where = lambda c, e: F.lit(0) if not e else F.size(F.filter(F.array(*map(F.lit, e)), lambda v: v < F.col(c)))
    g = g.select("x", "y", "n", where("x", edges[0]).alias("bx"), where("y", edges[1]).alias("by"))

    def count(own: str, other: str | None):
        def run(table: pa.Table) -> pa.Table:
            a, b, w = (table.column(c).to_numpy() for c in ("x", "y", "n"))
            return pa.table({"s": pa.array([concordance(a, b, w, table.column(other).to_numpy() if other else None)], pa.int64())})

        return g.groupBy(own).applyInArrow(run, "s long")

    near = count("bx", None).union(count("by", "bx")).agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0] or 0
    cells = g.groupBy("bx", "by").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((len(edges[0]) + 1, len(edges[1]) + 1), object)
    for i, j, k in zip(*(cells.column(c).to_pylist() for c in ("bx", "by", "n")), strict=True):
        grid[i, j] += k
    low, far = np.zeros(grid.shape[1], object), 0
    for row in grid:
        upto = np.concatenate([[0], np.cumsum(low)])
        far += sum(k * (upto[j] - (upto[-1] - upto[j + 1])) for j, k in enumerate(row) if k)
        low = low + row
    t = lambda c, name: g.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(name))
    one = g.agg(F.sum("n").alias("nn")).join(F.broadcast(t("x", "tx"))).join(F.broadcast(t("y", "ty")))  # one row each
    n0 = F.col("nn") * (F.col("nn") - 1) / 2
    return one.select((F.lit(float(int(near) + far)) / F.sqrt(nonzero((n0 - F.col("tx")) * (n0 - F.col("ty"))))).alias("tau_b"))


def p_adjust(df: DataFrame, p: str, method: str, key: str) -> DataFrame:
    """Adds p_adj: Bonferroni, Holm (running maximum) or Benjamini-Hochberg (running minimum from the largest p).
    key tells the tests apart."""
    need(method in ("bonferroni", "holm", "bh"), "method is bonferroni, holm or bh")
    n = df.count()
    if method == "bonferroni":
        return df.withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * n))
    rank, q = unused(df, "rank", "q")
    x = running(df, [p, key], **{rank: ("sum", F.lit(1))})
    if method == "holm":
        x = running(x.withColumn(q, (n - F.col(rank) + 1) * F.col(p)), [p, key], p_adj=("max", F.col(q)))
    else:
        x = running(x.withColumn(q, n * F.col(p) / F.col(rank)), [p, key], descending=True, p_adj=("min", F.col(q)))
    return x.withColumn("p_adj", F.least(F.lit(1.0), "p_adj")).drop(rank, q)
