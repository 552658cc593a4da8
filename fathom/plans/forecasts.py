"""Queries of the forecasting module."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import _O, BY, ORDER, _acf, query, series
from fathom.operators import forecasting
from fathom.session import ship


@query(_acf(2) + """, p AS (SELECT user_id, max(r) FILTER (WHERE lag = 1) AS r1, max(r) FILTER (WHERE lag = 2) AS r2 FROM a GROUP BY user_id)
SELECT user_id, 1 AS lag, r1 AS pacf FROM p WHERE r2 IS NOT NULL UNION ALL SELECT user_id, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM p WHERE r2 IS NOT NULL""")
def pacf(s, d):
    ship(s)
    return forecasting.partial_autocorrelation(series(s, d), "value", BY, ORDER, 2)


@query(_acf(2) + """, p AS (SELECT user_id, max(r) FILTER (WHERE lag = 1) AS r1, max(r) FILTER (WHERE lag = 2) AS r2 FROM a GROUP BY user_id), q AS (SELECT user_id, avg(value) AS mean, var_pop(value) AS v, count(value) AS n FROM events GROUP BY user_id)
SELECT user_id, mean, r1 * (1 - r2) / (1 - r1 * r1) AS phi1, (r2 - r1 * r1) / (1 - r1 * r1) AS phi2, v * (1 - r1 * r1) * (1 - pow((r2 - r1 * r1) / (1 - r1 * r1), 2)) AS sigma2 FROM p JOIN q USING (user_id) WHERE r2 IS NOT NULL AND n > 2 AND v > 0""")
def ar_yule_walker(s, d):
    ship(s)
    x = forecasting.fit_ar(series(s, d), "value", BY, ORDER, 2).where("phi IS NOT NULL")
    return x.select("user_id", "mean", F.col("phi")[0].alias("phi1"), F.col("phi")[1].alias("phi2"), "sigma2")


@query()
def ar_forecast(s, d):
    ship(s)
    return forecasting.forecast_ar(series(s, d), "value", BY, ORDER, 2, 3)


@query(f"""WITH x AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS e FROM events WHERE value IS NOT NULL), y AS (SELECT user_id, e, sum(e) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS s, lag(e, 1) OVER ({_O}) AS l1, lag(e, 2) OVER ({_O}) AS l2 FROM x),
z AS (SELECT user_id, count(*) AS n, sum(s * s) AS ss, sum(e * e) + 4.0 / 3 * coalesce(sum(e * l1), 0) + 2.0 / 3 * coalesce(sum(e * l2), 0) AS v FROM y GROUP BY user_id) SELECT user_id, n, CASE WHEN v <> 0 THEN ss / (n * v) END AS kpss FROM z""")
def kpss(s, d):
    return forecasting.kpss(series(s, d), "value", BY, ORDER, 2)


@query(f"""WITH x AS (SELECT user_id, lag(value) OVER ({_O}) AS x, value - lag(value) OVER ({_O}) AS y FROM events WHERE value IS NOT NULL), g AS (SELECT user_id, regr_count(y, x)::BIGINT AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM x WHERE x IS NOT NULL GROUP BY user_id)
SELECT user_id, n, CASE WHEN n > 2 THEN slope END AS slope, CASE WHEN n > 2 THEN slope / sqrt((syy - slope * slope * sxx) / ((n - 2) * sxx)) END AS t FROM g WHERE n > 2""")
def dickey_fuller(s, d):
    return forecasting.dickey_fuller(series(s, d), "value", BY, ORDER).where("n > 2")


@query(f"""WITH x AS (SELECT user_id, value AS y, lag(value) OVER ({_O}) AS a, lag(hour(ts)::DOUBLE) OVER ({_O}) AS b FROM events), g AS (SELECT user_id, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb,
    covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS "by", covar_pop(a, b) * count(*) AS ab FROM x WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY user_id),
r AS (SELECT user_id, n, yy - ay * ay / aa AS one, yy - (ay * bb - "by" * ab) / (aa * bb - ab * ab) * ay - ("by" * aa - ay * ab) / (aa * bb - ab * ab) * "by" AS two FROM g WHERE n > 10) SELECT user_id, n, round((one - two) * (n - 3) / two, 6) AS f FROM r""")
def granger(s, d):
    x = series(s, d).withColumn("h", F.hour("ts").cast("double"))
    return forecasting.granger_one_lag(x, "h", "value", BY, ORDER).where("n > 10").withColumn("f", F.round("f", 6))


@query(f"""WITH RECURSIVE x AS (SELECT event_id, user_id, value, row_number() OVER ({_O}) AS n, stddev_samp(value) OVER (PARTITION BY user_id) AS sd FROM events),
r AS (SELECT user_id, n, event_id, value, sd, value AS y, NULL::DOUBLE AS p FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, x.event_id, x.value, x.sd, 0.3 * x.value + 0.7 * r.y, r.y FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT event_id, user_id, coalesce(CASE WHEN sd <> 0 THEN (value - p) / sd END, 0) AS deviation, abs(coalesce(CASE WHEN sd <> 0 THEN (value - p) / sd END, 0)) > 2 AS anomaly FROM r""")
def ewma_anomalies(s, d):
    ship(s)
    return forecasting.ewma_anomalies(series(s, d), "value", BY, ORDER, ["event_id"], 0.3, 2.0).select("event_id", "user_id", "deviation", "anomaly")


@query(f"""WITH RECURSIVE x AS (SELECT event_id, user_id, value, row_number() OVER ({_O}) AS n FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, n, event_id, value, 1000.0::DOUBLE AS h FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, x.event_id, x.value, 100 + 0.2 * r.value * r.value + 0.7 * r.h FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT event_id, user_id, h FROM r""")
def garch_variance(s, d):
    ship(s)
    return forecasting.garch_filter(series(s, d), "value", BY, ORDER, ["event_id"], 100.0, 0.2, 0.7).select("event_id", "user_id", "h")


@query()
def kalman_smooth(s, d):
    ship(s)
    return forecasting.kalman_smooth(series(s, d), "value", BY, ORDER, 0.5, 4.0, ["event_id"]).select("event_id", "user_id", "level")
