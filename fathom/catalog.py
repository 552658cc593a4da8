"""Registered queries of the library over the driver's tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import columns, special
from fathom.operators import graph, matrix, models, numeric, resampling, stats, timeseries
from fathom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def series(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


BY, ORDER = ["user_id"], ["ts", "event_id"]
_O = "PARTITION BY user_id ORDER BY ts, event_id"


@query("SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS mean, median(l_quantity) AS median, var_samp(l_quantity) AS variance, stddev_samp(l_quantity) AS std_dev, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def describe_by_group(s, d):
    return stats.describe(t(s, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("SELECT c_custkey, c_mktsegment, c_acctbal, (c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def zscore_window(s, d):
    return stats.zscore(t(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"])


_M = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(f: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {f}({a}, {b}) AS v FROM lineitem" for a in _M for b in _M)


@query(_pairs("covar_samp"))
def covariance_matrix(s, d):
    return stats.moments(t(s, d, "lineitem"), _M)


@query(_pairs("corr"))
def correlation_matrix(s, d):
    return stats.moments(t(s, d, "lineitem"), _M, corr=True)


@query("""WITH a AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n,
    regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem), b AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS residual_se FROM a)
SELECT slope, intercept, r2, residual_se, residual_se / sqrt(sxx) AS slope_se, slope / (residual_se / sqrt(sxx)) AS t, n FROM b""")
def simple_ols(s, d):
    return stats.simple_ols(t(s, d, "lineitem"), "l_quantity", "l_extendedprice")


_ANOVA = """g AS (SELECT k, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY k), m AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
a AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * s) AS ssw FROM g, m)"""


@query(f"WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem), {_ANOVA} SELECT round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f_statistic, (k - 1)::BIGINT AS df_between, (nn - k)::BIGINT AS df_within FROM a")
def anova_oneway(s, d):
    return stats.anova(t(s, d, "lineitem"), "l_extendedprice", "l_returnflag").select(F.round("f_statistic", 6).alias("f_statistic"), "df_between", "df_within")


@query(f"WITH c AS (SELECT l_returnflag AS k, median(l_extendedprice) AS c FROM lineitem GROUP BY 1), x AS (SELECT k, abs(l_extendedprice - c) AS v FROM lineitem JOIN c ON l_returnflag = k), {_ANOVA} SELECT round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS w_statistic, (k - 1)::BIGINT AS df_between, (nn - k)::BIGINT AS df_within FROM a")
def levene_stat(s, d):
    return stats.levene(t(s, d, "lineitem"), "l_extendedprice", "l_returnflag").withColumn("w_statistic", F.round("w_statistic", 6))


@query("""WITH g AS (SELECT c_mktsegment AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM g)
SELECT a.k AS a, b.k AS b, a.m - b.m AS difference, abs(a.m - b.m) / sqrt(msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS q FROM g a JOIN g b ON a.k < b.k, w""")
def tukey_pairs_stat(s, d):
    return stats.tukey_pairs(t(s, d, "customer"), "c_acctbal", "c_mktsegment")


@query("SELECT (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM lineitem")
def t_one_sample(s, d):
    return stats.t_one_sample(t(s, d, "lineitem"), "l_quantity", 25.0)


_TWO = "WITH a AS (SELECT avg(v) FILTER (WHERE k = '{0}') AS m1, var_samp(v) FILTER (WHERE k = '{0}') AS v1, count(v) FILTER (WHERE k = '{0}') AS n1, avg(v) FILTER (WHERE k = '{1}') AS m2, var_samp(v) FILTER (WHERE k = '{1}') AS v2, count(v) FILTER (WHERE k = '{1}') AS n2 FROM (SELECT l_linestatus AS k, l_extendedprice AS v FROM lineitem))".format("F", "O")


@query(_TWO + " SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM a")
def t_pooled(s, d):
    return stats.t_two_sample(t(s, d, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", pooled=True)


@query(_TWO + " SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 / n1 * v1 / n1 / (n1 - 1) + v2 / n2 * v2 / n2 / (n2 - 1)) AS df FROM a")
def t_welch(s, d):
    return stats.t_two_sample(t(s, d, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", pooled=False)


@query("SELECT avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM lineitem")
def t_paired(s, d):
    return stats.t_paired(t(s, d, "lineitem"), "l_discount", "l_tax")


@query("""WITH a AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 25) AS x1, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 25) AS x2, count(*) FILTER (WHERE l_returnflag = 'N') AS n2 FROM lineitem),
b AS (SELECT *, (x1 + x2)::DOUBLE / (n1 + n2) AS p FROM a) SELECT (x1::DOUBLE / n1 - x2::DOUBLE / n2) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) AS z, x1::DOUBLE / n1 AS p1, x2::DOUBLE / n2 AS p2 FROM b""")
def z_two_proportion(s, d):
    return stats.z_two_proportion(t(s, d, "lineitem"), "l_returnflag", "A", "N", F.col("l_quantity") > 25)


@query("WITH g AS (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority) SELECT sum(c * c)::DOUBLE * count(*) / sum(c) - sum(c) AS chi2, count(*) - 1 AS df FROM g")
def chi2_gof(s, d):
    return stats.chi2_gof(t(s, d, "orders"), "o_orderpriority")


@query("""WITH g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS c FROM orders GROUP BY ALL), j AS (SELECT *, sum(c) OVER (PARTITION BY a) AS r, sum(c) OVER (PARTITION BY b) AS k FROM g),
x AS (SELECT sum(c::DOUBLE * c / (r::DOUBLE * k)) AS s, sum(c) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM j) SELECT n * (s - 1) AS chi2, (ka - 1) * (kb - 1) AS df, sqrt((s - 1) / least(ka - 1, kb - 1)) AS cramers_v FROM x""")
def chi2_independence(s, d):
    return stats.chi2_independence(t(s, d, "orders"), "o_orderstatus", "o_orderpriority")


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""WITH r AS (SELECT l_linestatus AS k, l_quantity AS v, {_RANK.format("l_quantity")} AS r FROM lineitem), q AS (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity),
a AS (SELECT sum(r) FILTER (WHERE k = 'F') AS r1, (count(*) FILTER (WHERE k = 'F'))::DOUBLE AS n1, (count(*) FILTER (WHERE k = 'O'))::DOUBLE AS n2 FROM r), b AS (SELECT sum(c * c * c - c) AS ties FROM q)
SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2) AS u2, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM a, b""")
def mann_whitney(s, d):
    return stats.mann_whitney(t(s, d, "lineitem"), "l_quantity", "l_linestatus", "F", "O")


@query(f"WITH x AS (SELECT l_discount - l_tax AS d, abs(l_discount - l_tax) AS a FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, {_RANK.format('a')} AS r FROM x) SELECT coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus, count(*) AS n FROM r")
def wilcoxon(s, d):
    return stats.wilcoxon(t(s, d, "lineitem"), "l_discount", "l_tax")


@query(f"""WITH r AS (SELECT l_returnflag AS k, {_RANK.format("l_quantity")} AS r FROM lineitem), g AS (SELECT sum(r) AS r, count(*)::DOUBLE AS n FROM r GROUP BY k), q AS (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity),
a AS (SELECT sum(r * r / n) AS s, sum(n) AS n, count(*) AS k FROM g), b AS (SELECT sum(c * c * c - c) AS ties FROM q) SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k - 1 AS df FROM a, b""")
def kruskal(s, d):
    return stats.kruskal(t(s, d, "lineitem"), "l_quantity", "l_returnflag")


@query("""WITH u AS (SELECT c_acctbal AS v, 1 AS p, 0 AS q FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier), g AS (SELECT v, sum(p) AS p, sum(q) AS q FROM u GROUP BY v),
f AS (SELECT sum(p) OVER (ORDER BY v)::DOUBLE / sum(p) OVER () AS f, sum(q) OVER (ORDER BY v)::DOUBLE / sum(q) OVER () AS g, sum(p) OVER () AS n1, sum(q) OVER () AS n2 FROM g) SELECT max(abs(f - g)) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM f""")
def ks_two_sample_d(s, d):
    return stats.ks_two_sample(t(s, d, "customer"), "c_acctbal", t(s, d, "supplier"), "s_acctbal")


@query(f"WITH r AS (SELECT {_RANK.format('p_size')} AS a, {_RANK.format('p_retailprice')} AS b FROM part) SELECT corr(a, b) AS rho FROM r")
def spearman(s, d):
    return stats.spearman(t(s, d, "part"), "p_size", "p_retailprice")


@query("""WITH g AS (SELECT l_linenumber AS x, l_quantity AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), s AS (SELECT sum(sign(q.y - p.y) * p.n * q.n) AS s FROM g p JOIN g q ON p.x < q.x),
a AS (SELECT sum(m * (m - 1) / 2) AS tx FROM (SELECT sum(n) AS m FROM g GROUP BY x)), b AS (SELECT sum(m * (m - 1) / 2) AS ty FROM (SELECT sum(n) AS m FROM g GROUP BY y)), c AS (SELECT sum(n) AS n FROM g)
SELECT s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau_b FROM s, a, b, c""")
def kendall(s, d):
    return stats.kendall(t(s, d, "lineitem"), "l_linenumber", "l_quantity")


def _p(s, d):
    return t(s, d, "nation").select("n_nationkey", (F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25)) / 250.0 + 0.001).alias("p"))


_PSQL = "WITH x AS (SELECT n_nationkey, ((n_nationkey * 7 + 3) % 25) / 250.0::DOUBLE + 0.001::DOUBLE AS p, count(*) OVER () AS n FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, n_nationkey) AS r FROM x)"


@query("SELECT n_nationkey, ((n_nationkey * 7 + 3) % 25) / 250.0::DOUBLE + 0.001::DOUBLE AS p, least(1.0, (((n_nationkey * 7 + 3) % 25) / 250.0::DOUBLE + 0.001::DOUBLE) * count(*) OVER ())::DOUBLE AS p_adj FROM nation")
def p_adjust_bonferroni(s, d):
    return stats.p_adjust(_p(s, d), "p", "bonferroni", "n_nationkey")


@query(_PSQL + " SELECT n_nationkey, p, least(1.0, max((n - r + 1) * p) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS p_adj FROM r")
def p_adjust_holm(s, d):
    return stats.p_adjust(_p(s, d), "p", "holm", "n_nationkey")


@query(_PSQL + " SELECT n_nationkey, p, least(1.0, min(n * p / r) OVER (ORDER BY p DESC, n_nationkey DESC ROWS UNBOUNDED PRECEDING))::DOUBLE AS p_adj FROM r")
def p_adjust_bh(s, d):
    return stats.p_adjust(_p(s, d), "p", "bh", "n_nationkey")


@query(f"SELECT event_id, user_id, sma FROM (SELECT *, avg(value) OVER ({_O} ROWS 4 PRECEDING) AS sma, row_number() OVER ({_O}) AS n FROM events) WHERE n >= 5")
def sma(s, d):
    return timeseries.sma(series(s, d), "value", BY, ORDER, 5).select("event_id", "user_id", "sma")


@query(f"SELECT event_id, user_id, diff FROM (SELECT *, value - lag(value) OVER ({_O}) AS diff FROM events) WHERE diff IS NOT NULL")
def diff(s, d):
    return timeseries.difference(series(s, d), "value", BY, ORDER).select("event_id", "user_id", "diff")


@query(f"SELECT event_id, user_id, diff FROM (SELECT *, value - lag(value, 7) OVER ({_O}) AS diff FROM events) WHERE diff IS NOT NULL")
def seasonal_diff(s, d):
    return timeseries.difference(series(s, d), "value", BY, ORDER, 7).select("event_id", "user_id", "diff")


@query(f"SELECT event_id, user_id, value - avg(value) OVER ({_O} ROWS 4 PRECEDING) AS residual FROM events")
def ma_residuals(s, d):
    return timeseries.moving_average_residuals(series(s, d), "value", BY, ORDER, 5).select("event_id", "user_id", "residual")


@query(f"""WITH x AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, row_number() OVER ({_O}) AS n FROM events WINDOW w AS ({_O} ROWS 9 PRECEDING))
SELECT event_id, user_id, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END AS z, abs(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END) > 2.5 AS anomaly FROM x WHERE n >= 10""")
def rolling_z(s, d):
    return timeseries.rolling_z(series(s, d), "value", BY, ORDER, 10, 2.5).select("event_id", "user_id", "z", "anomaly")


def _acf(lags: int) -> str:
    cols = ", ".join(f"lag(d, {k}) OVER ({_O}) AS l{k}" for k in range(1, lags + 1))
    return f"WITH x AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), y AS (SELECT user_id, d, {cols} FROM x), a AS (" + " UNION ALL ".join(f"SELECT user_id, count(*) AS n, {k} AS lag, sum(d * l{k}) / sum(d * d) AS r FROM y GROUP BY user_id" for k in range(1, lags + 1)) + ")"


@query(_acf(5) + " SELECT user_id, n, lag, r FROM a")
def acf(s, d):
    return timeseries.acf(series(s, d), "value", BY, ORDER, 5)


@query(_acf(5) + " SELECT user_id, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q, 5 AS df FROM a GROUP BY user_id")
def ljung_box_q(s, d):
    return timeseries.ljung_box(series(s, d), "value", BY, ORDER, 5)


@query(f"""WITH x AS (SELECT user_id, value - avg(value) OVER p AS x, lead(hour(ts)::DOUBLE, 2) OVER ({_O}) AS l, avg(hour(ts)) OVER p AS my, hour(ts) - avg(hour(ts)) OVER p AS y FROM events WINDOW p AS (PARTITION BY user_id))
SELECT user_id, sum(x * (l - my)) / sqrt(sum(x * x) * sum(y * y)) AS ccf FROM x GROUP BY user_id""")
def ccf(s, d):
    return timeseries.ccf(series(s, d).withColumn("h", F.hour("ts").cast("double")), "value", "h", BY, ORDER, 2)


def _recursive(first: str, step: str, out: str) -> str:
    return f"""WITH RECURSIVE x AS (SELECT event_id, user_id, value, row_number() OVER ({_O}) AS n, lead(value) OVER ({_O}) AS nxt FROM events),
r AS (SELECT user_id, n, event_id, {first} FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, x.event_id, {step} FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT event_id, user_id, {out} FROM r"""


@query(_recursive("value AS y", "0.3 * x.value + 0.7 * r.y", "y AS ema"))
def ema(s, d):
    return timeseries.ema(series(s, d), "value", BY, ORDER, 0.3).select("event_id", "user_id", "ema")


@query(_recursive("value AS y, coalesce(nxt - value, 0) AS b", "0.4 * x.value + 0.6 * (r.y + r.b), 0.2 * (0.4 * x.value + 0.6 * (r.y + r.b) - r.y) + 0.8 * r.b", "y AS level"))
def holt(s, d):
    return timeseries.holt(series(s, d), "value", BY, ORDER, 0.4, 0.2).select("event_id", "user_id", "level")


@query(_recursive("value AS y, 1.0::DOUBLE AS p", "r.y + (r.p + 0.5) / (r.p + 0.5 + 4.0) * (x.value - r.y), (r.p + 0.5) * (1 - (r.p + 0.5) / (r.p + 0.5 + 4.0))", "y AS level"))
def kalman_local_level(s, d):
    return timeseries.kalman_local_level(series(s, d), "value", BY, ORDER, 0.5, 4.0).select("event_id", "user_id", "level")


@query(f"""WITH x AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), c AS (SELECT user_id, row_number() OVER ({_O}) AS position, sum(d) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS c FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(c), 9) DESC, position) AS k FROM c) SELECT user_id, position::INTEGER AS position, abs(c) AS cusum FROM r WHERE k = 1""")
def change_point(s, d):
    return timeseries.change_point(series(s, d), "value", BY, ORDER)


@query("""WITH g AS (SELECT user_id, arg_min(value, struct_pack(ts := ts, e := event_id)) AS a, arg_max(value, struct_pack(ts := ts, e := event_id)) AS z, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, h::INTEGER AS h, z + h * (z - a) / (n - 1) AS drift, z AS naive FROM g, range(1, 4) r(h) WHERE n > 1""")
def drift_forecast(s, d):
    return timeseries.drift_forecast(series(s, d), "value", BY, ORDER, 3)


@query("SELECT event_type, avg(abs(value - 50)) AS mae, avg((value - 50) * (value - 50)) AS mse, sqrt(avg((value - 50) * (value - 50))) AS rmse, avg(abs((value - 50) / value)) FILTER (WHERE value <> 0) * 100 AS mape FROM events GROUP BY 1")
def forecast_metrics(s, d):
    return timeseries.forecast_metrics(series(s, d).withColumn("f", F.lit(50.0)), "value", "f", ["event_type"])


@query(f"""WITH x AS (SELECT *, row_number() OVER ({_O}) - 1 AS n, avg(value) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t, count(*) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c FROM events),
y AS (SELECT *, CASE WHEN c = 7 THEN t END AS trend, (n % 7)::INTEGER AS season FROM x), z AS (SELECT *, avg(value - trend) OVER (PARTITION BY user_id, season) AS seasonal FROM y)
SELECT event_id, user_id, season, trend, seasonal, value - trend - seasonal AS remainder FROM z""")
def decompose_additive(s, d):
    return timeseries.decompose_additive(series(s, d), "value", BY, ORDER, 7).select("event_id", "user_id", "season", "trend", "seasonal", "remainder")


@query("""WITH a AS (SELECT covar_pop(l_quantity, l_extendedprice) AS cy1, covar_pop(l_discount, l_extendedprice) AS cy2, covar_pop(l_quantity, l_discount) AS c12, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
b AS (SELECT *, (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) AS b1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM a)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 4) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b1, 4) FROM b UNION ALL SELECT 'l_discount', round(b2, 4) FROM b""")
def ols_two_features(s, d):
    return models.linear_model(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).withColumn("coefficient", F.round("coefficient", 4))


@query("""WITH a AS (SELECT sum(l_tax + 1) AS w, sum((l_tax + 1) * l_quantity) / sum(l_tax + 1) AS mx, sum((l_tax + 1) * l_extendedprice) / sum(l_tax + 1) AS my FROM lineitem),
b AS (SELECT sum((l_tax + 1) * (l_quantity - mx) * (l_extendedprice - my)) / sum((l_tax + 1) * (l_quantity - mx) * (l_quantity - mx)) AS b, any_value(mx) AS mx, any_value(my) AS my FROM lineitem, a)
SELECT 'intercept' AS term, round(my - b * mx, 4) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b, 4) FROM b""")
def wls(s, d):
    return models.linear_model(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], weight=F.col("l_tax") + 1).withColumn("coefficient", F.round("coefficient", 4))


@query("""WITH a AS (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1000) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT 'intercept' AS term, round(my - b * mx, 4) AS coefficient FROM a UNION ALL SELECT 'l_quantity', round(b, 4) FROM a""")
def ridge_one_feature(s, d):
    x = models.linear_model(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], ridge=1000.0)
    return x.withColumn("coefficient", F.round("coefficient", 4))


@query("WITH x AS (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS e FROM lineitem) SELECT avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(y)) AS r2 FROM x")
def regression_metrics(s, d):
    return models.regression_metrics(t(s, d, "lineitem"), "l_extendedprice", F.col("l_quantity") * 1500)


def _flags(s, d):
    x = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("quality", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("guess"), F.col("n_chars").cast("double").alias("score"))


_FLAGS = "WITH f AS (SELECT quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS guess, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@query(_FLAGS + " SELECT quality AS actual, guess AS predicted, count(*) AS n FROM f GROUP BY ALL")
def confusion(s, d):
    return models.confusion(_flags(s, d), "quality", "guess")


@query(_FLAGS + """, c AS (SELECT DISTINCT quality AS class FROM f UNION SELECT DISTINCT guess FROM f), g AS (SELECT class, (SELECT count(*) FROM f WHERE quality = class AND guess = class) AS tp, (SELECT count(*) FROM f WHERE guess = class) AS said, (SELECT count(*) FROM f WHERE quality = class) AS "is" FROM c),
h AS (SELECT class, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS precision, CASE WHEN "is" > 0 THEN tp::DOUBLE / "is" ELSE 0 END AS recall, "is" AS support FROM g) SELECT class, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM h""")
def class_report(s, d):
    return models.class_report(_flags(s, d), "quality", "guess")


@query(_FLAGS + f", r AS (SELECT quality, {_RANK.format('score')} AS r FROM f), a AS (SELECT sum(r) FILTER (WHERE quality > 0) AS r, count(*) FILTER (WHERE quality > 0) AS p, count(*) AS n FROM r) SELECT (r - p * (p + 1) / 2) / (p::DOUBLE * (n - p)) AS auc FROM a")
def auc(s, d):
    return models.auc(_flags(s, d), "quality", "score")


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, count(*)::DOUBLE / sum(count(*)) OVER () AS prior, avg({c}) AS mean, var_pop({c}) AS variance FROM lineitem GROUP BY l_returnflag" for c in ("l_quantity", "l_discount")))
def naive_bayes_fit(s, d):
    return models.naive_bayes_fit(t(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q_id, vec_id, label, list_sum(list_transform(list_zip(e, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q JOIN embeddings ON q_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS r FROM p), v AS (SELECT q_id, label, count(*) AS n FROM r WHERE r <= 5 GROUP BY ALL) SELECT q_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, label) AS k FROM v) WHERE k = 1""")
def knn_classify(s, d):
    e = t(s, d, "embeddings")
    return models.knn(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 5)


def _coo(s, d):
    return matrix.coo(t(s, d, "lineitem").select(F.pmod("l_partkey", F.lit(97)).alias("p"), F.pmod("l_suppkey", F.lit(89)).alias("q"), "l_quantity"), "p", "q", "l_quantity")


_COO = "WITH a AS (SELECT l_partkey % 97 AS i, l_suppkey % 89 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(_COO + " SELECT i, j, v FROM a")
def coo_from_triplets(s, d):
    return _coo(s, d)


@query(_COO + " SELECT j AS i, i AS j, v FROM a")
def coo_transpose(s, d):
    return matrix.transpose(_coo(s, d))


@query(_COO + ", u AS (SELECT i, j, v FROM a UNION ALL SELECT j, i, v * 2 FROM a) SELECT i, j, sum(v) AS v FROM u GROUP BY ALL")
def coo_add(s, d):
    return matrix.add(_coo(s, d), matrix.transpose(_coo(s, d)), 1.0, 2.0)


@query(_COO + " SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY ALL")
def coo_matmul(s, d):
    a = _coo(s, d)
    return matrix.matmul(a, matrix.transpose(a))


@query(_COO + " SELECT i, sum(v * (j + 1)) AS v FROM a GROUP BY i")
def spmv(s, d):
    a = _coo(s, d)
    return matrix.spmv(a, a.select(F.col("j").alias("i")).distinct().withColumn("v", F.col("i") + 1.0))


@query(_COO + " SELECT sqrt(sum(v * v)) AS frobenius, max(abs(v)) AS max_norm, coalesce(sum(v) FILTER (WHERE i = j), 0) AS trace, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)) AS inf_norm, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY j)) AS one_norm FROM a")
def matrix_norms(s, d):
    return matrix.norms(_coo(s, d))


@query(_COO + " SELECT coalesce(max(abs(g)), 0) <= 1e-12 AS symmetric, coalesce(max(abs(g)), 0) AS gap FROM (SELECT sum(v) AS g FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, -v FROM a) GROUP BY i, j)")
def is_symmetric(s, d):
    return matrix.is_symmetric(_coo(s, d))


def _edges(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


_EDGES = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"


@query(f"WITH {_EDGES} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")
def degree(s, d):
    return graph.degrees(_edges(s, d))


def _pagerank(rounds: int) -> str:
    out = f"WITH {_EDGES}, p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85 * (coalesce((SELECT sum(r.rank * p.p) FROM r{k} r JOIN p ON r.id = p.src WHERE p.dst = v.id), 0) + coalesce((SELECT sum(rank) FROM r{k} WHERE id NOT IN (SELECT src FROM p)), 0) / (SELECT count(*) FROM v)) AS rank FROM v)"
    return out + f" SELECT id, rank FROM r{rounds}"


@query(_pagerank(3))
def pagerank_k_iters(s, d):
    return graph.pagerank(_edges(s, d), rounds=3)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 3 AS id, 0.0::DOUBLE AS distance, 0 AS k UNION SELECT e.dst, r.distance + e.w, k + 1 FROM r JOIN e ON r.id = e.src WHERE k < 3) SELECT id, min(distance) AS distance FROM r GROUP BY id")
def sssp_bounded(s, d):
    return graph.shortest_paths(materialise(_edges(s, d), "edges"), 3, hops=3)


@query()
def sssp(s, d):
    return graph.shortest_paths(materialise(_edges(s, d), "edges"), 3)


@query("""WITH k AS (SELECT user_id, epoch(ts) AS x, avg(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY ALL), q AS (SELECT event_id, user_id, epoch(ts) AS x FROM events WHERE event_type <> 'purchase'),
a AS (SELECT q.*, k.x AS ax, k.y AS ay FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.x >= k.x), b AS (SELECT a.*, k.x AS bx, k.y AS byy FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.x <= k.x)
SELECT event_id, user_id, CASE WHEN x = ax THEN ay ELSE ay + (x - ax) / (bx - ax) * (byy - ay) END AS y FROM b""")
def linear_interp_asof(s, d):
    e = series(s, d).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    k = e.where("event_type = 'purchase'").groupBy("user_id", "x").agg(F.avg("value").alias("y"))
    return numeric.interpolate(k, e.where("event_type <> 'purchase'").select("event_id", "user_id", "x"), "x", "y", BY).select("event_id", "user_id", "y")


@query(f"WITH x AS (SELECT *, epoch(ts) AS x FROM events), y AS (SELECT user_id, (x - lag(x) OVER ({_O})) * (value + lag(value) OVER ({_O})) / 2 AS a FROM x) SELECT user_id, sum(a) AS integral FROM y GROUP BY user_id")
def trapezoid_integral(s, d):
    return numeric.trapezoid(series(s, d).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), "x", "value", BY, "event_id")


@query("WITH g AS (SELECT count(*)::DOUBLE AS n FROM documents GROUP BY source), p AS (SELECT n / sum(n) OVER () AS p FROM g) SELECT -sum(p * log2(p)) AS entropy FROM p")
def entropy(s, d):
    return numeric.entropy(t(s, d, "documents"), "source")


@query("""WITH g AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY lang) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY source) / sum(n) OVER () AS b FROM g)
SELECT sum(p * log2(p / (a * b))) AS mutual_information FROM p""")
def mutual_information(s, d):
    return numeric.mutual_information(t(s, d, "documents"), "lang", "source")


@query("""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 50) AS a, count(*) FILTER (WHERE value <= 50) AS b FROM events GROUP BY 1), x AS (SELECT a::DOUBLE / sum(a) OVER () AS p, b::DOUBLE / sum(b) OVER () AS q FROM g)
SELECT sum(-p * log2(q)) AS cross_entropy, sum(p * log2(p / q)) AS kl, sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2) AS js FROM x""")
def divergences(s, d):
    return numeric.divergences(t(s, d, "events"), "event_type", F.col("value") > 50, F.col("value") <= 50)


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) + 1.0 AS alpha, count(*) FILTER (WHERE NOT value > 50) + 1.0 AS beta, (count(*) FILTER (WHERE value > 50) + 1.0) / (count(*) + 2.0) AS mean FROM events GROUP BY 1")
def conjugate_updates(s, d):
    return numeric.beta_binomial(t(s, d, "events"), ["event_type"], F.col("value") > 50)


@query(f"SELECT event_id, user_id, 0.5 * value + 0.3 * coalesce(lag(value, 1) OVER ({_O}), 0) + 0.2 * coalesce(lag(value, 2) OVER ({_O}), 0) AS filtered FROM events")
def fir_filter(s, d):
    return numeric.fir(series(s, d), "value", BY, ORDER, [0.5, 0.3, 0.2]).select("event_id", "user_id", "filtered")


@query(f"""WITH x AS (SELECT user_id, value, row_number() OVER ({_O}) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events), f AS (SELECT user_id, unnest(range(0, m - 7, 4)) AS start FROM (SELECT DISTINCT user_id, m FROM x))
SELECT x.user_id, (start // 4)::INTEGER AS frame, (n - start)::INTEGER AS position, value FROM f JOIN x ON x.user_id = f.user_id AND n BETWEEN start AND start + 7""")
def stft_frames(s, d):
    return numeric.frames(series(s, d), "value", BY, ORDER, 8, 4)


@query(f"""WITH x AS (SELECT user_id, value, row_number() OVER ({_O}) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events), y AS (SELECT user_id, bin::INTEGER AS bin, sum(value * cos(-2 * pi() * ((bin * n) % m) / m)) AS re, sum(value * sin(-2 * pi() * ((bin * n) % m) / m)) AS im FROM x, range(0, 4) r(bin) GROUP BY ALL)
SELECT user_id, bin, round(re * re + im * im, 3) AS power FROM y""")
def direct_dft_power(s, d):
    return numeric.dft_power(series(s, d), "value", BY, ORDER, 4).withColumn("power", F.round("power", 3))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS value, sqrt(l_discount * l_discount * 0.25 + l_quantity * l_quantity * l_tax * l_tax) AS std_dev FROM lineitem")
def uncertainty_product(s, d):
    v, sd = numeric.product_uncertainty(F.col("l_quantity"), F.lit(0.5), F.col("l_discount"), F.col("l_tax"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("value"), sd.alias("std_dev"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_discount - l_tax * 2 AS re, l_quantity * 2 + l_tax * l_discount AS im FROM lineitem")
def complex_product(s, d):
    re, im = numeric.complex_product(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.lit(2.0))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", re.alias("re"), im.alias("im"))


@query("SELECT l_orderkey, l_linenumber, least((l_tax - 1) * -2, (l_tax - 1) * l_quantity, l_discount * -2, l_discount * l_quantity) AS lower, greatest((l_tax - 1) * -2, (l_tax - 1) * l_quantity, l_discount * -2, l_discount * l_quantity) AS upper FROM lineitem")
def interval_product(s, d):
    lo, hi = numeric.interval_product(F.col("l_tax") - 1, F.col("l_discount"), F.lit(-2.0), F.col("l_quantity"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lower"), hi.alias("upper"))


@query("WITH a AS (SELECT p_partkey AS id, p_size::DOUBLE AS lo, p_size + 0.5 AS hi FROM part), b AS (SELECT s_suppkey AS id, s_suppkey % 50 + 0.25 AS lo, s_suppkey % 50 + 1.25 AS hi FROM supplier) SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.lo <= b.hi AND b.lo <= a.hi")
def interval_overlap_join(s, d):
    a = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 0.5).alias("hi"))
    b = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50 + 0.25).alias("lo"), (F.col("s_suppkey") % 50 + 1.25).alias("hi"))
    return numeric.overlaps(a, b, "lo", "hi", 2.0)


@query("SELECT l_orderkey, l_linenumber, round(0 - l_discount, 9) + 0.0 AS x, round(l_quantity, 9) + 0.0 AS y, round(l_tax, 9) + 0.0 AS z FROM lineitem")
def quaternion_rotate(s, d):
    h = F.lit(0.5**0.5)
    x, y, z = numeric.quaternion_rotate((h, F.lit(0.0), F.lit(0.0), h), (F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *((F.round(v, 9) + 0.0).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))))


# with 2 degrees of freedom above, the survival function has a closed form
@query(f"""WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem), {_ANOVA}, f AS (SELECT (ssb / (k - 1)) / (ssw / (nn - k)) AS f, (k - 1)::BIGINT AS df_between, (nn - k)::BIGINT AS df_within FROM a)
SELECT round(f, 6) AS f_statistic, df_between, df_within, round(power(1 + 2 * f / df_within, -df_within / 2.0), 6) AS p_value FROM f""")
def anova_p_value(s, d):
    a = stats.anova(t(s, d, "lineitem"), "l_extendedprice", "l_returnflag")
    p = special.column("f_sf", "f_statistic", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return a.select(F.round("f_statistic", 6).alias("f_statistic"), "df_between", "df_within", F.round(p, 6).alias("p_value"))


@query("""WITH x AS (SELECT event_id, value / 50 AS x FROM events) SELECT event_id, exp(-x * x / 2) / sqrt(2 * pi()) AS normal, 1 - exp(-x) AS exponential, 1 / (1 + exp(-x)) AS logistic, CASE WHEN x < 1 THEN 0 ELSE 1 - power(1 / x, 2.0) END AS pareto, 1 - exp(-power(x, 1.5)) AS weibull,
    atan(x) / pi() + 0.5 AS cauchy, exp(-exp(-x)) AS gumbel, 1 + x * (2 + x * 3) AS polynomial FROM x""")
def distribution_columns(s, d):
    x = F.col("x")
    return t(s, d, "events").select("event_id", (F.col("value") / 50).alias("x")).select(
        "event_id", columns.normal_pdf(x).alias("normal"), columns.exponential_cdf(x, 1.0).alias("exponential"), columns.logistic_cdf(x).alias("logistic"), columns.pareto_cdf(x, 2.0, 1.0).alias("pareto"),
        columns.weibull_cdf(x, 1.5, 1.0).alias("weibull"), columns.cauchy_cdf(x).alias("cauchy"), columns.gumbel_cdf(x).alias("gumbel"), columns.polynomial(x, [1, 2, 3]).alias("polynomial"),
    )


@query()
def bootstrap_ci(s, d):
    return resampling.bootstrap_mean(t(s, d, "customer"), "c_acctbal", "c_custkey", 200)


@query()
def permutation_p(s, d):
    return resampling.permutation_p(t(s, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING", "c_custkey", 200)


@query()
def mc_integrate(s, d):
    return resampling.mc_integrate(s, lambda x: x * x, 0.0, 3.0, 1_000_000)


@query()
def logistic_regression(s, d):
    return models.logistic(_flags(s, d), "quality", ["score"])


@query("SELECT event_type, count(*)::DOUBLE + 1 AS shape, count(DISTINCT user_id)::DOUBLE + 1 AS rate, (count(*)::DOUBLE + 1) / (count(DISTINCT user_id) + 1) AS mean FROM events GROUP BY 1")
def gamma_poisson(s, d):
    return numeric.gamma_poisson(t(s, d, "events"), ["event_type"])
