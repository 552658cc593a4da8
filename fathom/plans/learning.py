"""Queries of the learning module."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import _FLAGS, _flags, query, t
from fathom.operators import learning, models


@query("""WITH a AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT sign(c) * greatest(abs(c) - 5000, 0) / v AS b, mx, my FROM a)
SELECT 'intercept' AS term, round(my - b * mx, 4) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b, 4) FROM b""")
def lasso_one_feature(s, d):
    return learning.elastic_net(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], 5000.0).withColumn("coefficient", F.round("coefficient", 4))


@query("""WITH a AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT sign(c) * greatest(abs(c) - 50, 0) / (v + 50) AS b, mx, my FROM a)
SELECT 'intercept' AS term, round(my - b * mx, 4) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b, 4) FROM b""")
def elastic_net_one_feature(s, d):
    return learning.elastic_net(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], 100.0, 0.5).withColumn("coefficient", F.round("coefficient", 4))


@query("SELECT 'intercept' AS term, round(ln(avg(l_quantity) FILTER (WHERE l_linestatus <> 'F')), 6) AS coefficient FROM lineitem UNION ALL SELECT 'f', round(ln(avg(l_quantity) FILTER (WHERE l_linestatus = 'F')) - ln(avg(l_quantity) FILTER (WHERE l_linestatus <> 'F')), 6) FROM lineitem")
def poisson_two_groups(s, d):
    x = t(s, d, "lineitem").select("l_quantity", F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("f"))
    return learning.poisson_regression(x, "l_quantity", ["f"]).withColumn("coefficient", F.round("coefficient", 6))


@query("""WITH a AS (SELECT covar_pop(x, y) AS xy, covar_pop(x * x, y) AS qy, var_pop(x) AS xx, var_pop(x * x) AS qq, covar_pop(x, x * x) AS xq, avg(x) AS mx, avg(x * x) AS mq, avg(y) AS my FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part)),
b AS (SELECT *, (xy * qq - qy * xq) / (xx * qq - xq * xq) AS b1, (qy * xx - xy * xq) / (xx * qq - xq * xq) AS b2 FROM a) SELECT 0 AS power, round(my - b1 * mx - b2 * mq, 5) AS coefficient FROM b UNION ALL SELECT 1, round(b1, 5) FROM b UNION ALL SELECT 2, round(b2, 5) FROM b""")
def polynomial_fit(s, d):
    return learning.polynomial_fit(t(s, d, "part"), "p_size", "p_retailprice", 2).withColumn("coefficient", F.round("coefficient", 5))


@query(_FLAGS + """, g AS (SELECT quality, count(*) AS n, avg(score) AS m, greatest(var_pop(score), 1e-9) AS v FROM f GROUP BY 1), p AS (SELECT g.*, n / sum(n) OVER () AS pr FROM g),
x AS (SELECT doc_id, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), y AS (SELECT doc_id, quality, ln(pr) - 0.5 * ln(2 * pi() * v) - (score - m) * (score - m) / (2 * v) AS s FROM x, p)
SELECT doc_id, arg_max(quality, s) AS predicted FROM y GROUP BY doc_id""")
def naive_bayes_predict(s, d):
    x = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")
    model = models.naive_bayes_fit(_flags(s, d), "quality", ["score"])
    return learning.naive_bayes_predict(x, model, "doc_id", "quality", ["score"])


@query()
def decision_tree(s, d):
    return learning.decision_tree(t(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query()
def softmax_regression(s, d):
    return learning.softmax_fit(_flags(s, d), "quality", ["score"], rounds=20)


@query()
def cross_validated_mse(s, d):
    return learning.cross_validated_mse(t(s, d, "orders"), "o_totalprice", ["o_custkey"], "o_orderkey")


@query("""WITH t AS (SELECT c_mktsegment = 'BUILDING' AS a, c_acctbal > 5000 AS b FROM customer),
c AS (SELECT count(*) FILTER (WHERE a AND b) AS n11, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE NOT a AND NOT b) AS n00 FROM t),
k AS (SELECT *, unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) AS k FROM c),
l AS (SELECT *, -(lgamma(k + 1) + lgamma(n11 + n10 - k + 1) + lgamma(n11 + n01 - k + 1) + lgamma(n00 - n11 + k + 1)) AS x, -(lgamma(n11 + 1) + lgamma(n10 + 1) + lgamma(n01 + 1) + lgamma(n00 + 1)) AS seen FROM k)
SELECT n11, n10, n01, n00, round(least(1, sum(exp(x - seen)) FILTER (WHERE exp(x - seen) <= 1 + 1e-7) / sum(exp(x - seen))), 8) AS p_value FROM l GROUP BY n11, n10, n01, n00""")
def fisher_exact(s, d):
    return learning.fisher_exact(t(s, d, "customer"), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 5000).withColumn("p_value", F.round("p_value", 8))


@query("""WITH g AS (SELECT c_acctbal AS v, count(*) AS c FROM customer GROUP BY 1), u AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS u, sum(c) OVER () AS n FROM g), f AS (SELECT *, least(greatest((v + 1000) / 11000, 0), 1) AS f FROM u)
SELECT max(greatest(abs(u / n - f), abs((u - c) / n - f))) AS d, sum(c)::BIGINT AS n FROM f""")
def ks_uniform(s, d):
    from fathom.functions.distributions import uniform_cdf

    return learning.ks_one_sample(t(s, d, "customer"), "c_acctbal", lambda v: uniform_cdf(v, -1000.0, 10000.0))


_W = {"l_discount": 20.0, "l_quantity": -0.05}
_Z = "0.5 + 20.0 * l_discount - 0.05 * l_quantity"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_Z} AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, z AS linear, 1 / (1 + exp(-z)) AS probability, (1 / (1 + exp(-z)) >= 0.5)::INTEGER AS class FROM x""")
def predictions(s, d):
    keep = ["l_orderkey", "l_linenumber"]
    return t(s, d, "lineitem").select(*keep, models.linear_prediction(0.5, _W).alias("linear"), models.logistic_probability(0.5, _W).alias("probability"), models.logistic_class(0.5, _W).alias("class"))


@query(f"""WITH x AS (SELECT (l_returnflag = 'R')::INTEGER AS y, 1 / (1 + exp(-({_Z}))) AS p FROM lineitem), c AS (SELECT y, p, (p >= 0.5)::INTEGER AS c FROM x),
f AS (SELECT k, 2.0 * count(*) FILTER (WHERE y = k AND c = k) / nullif(count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE c = k), 0) AS f1 FROM c, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT avg((y = c)::INTEGER) AS accuracy, avg(-CASE WHEN y > 0 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, (SELECT avg(coalesce(f1, 0)) FROM f) AS macro_f1 FROM c""")
def classifier_scores(s, d):
    x = t(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), models.logistic_probability(0.5, _W).alias("p")).withColumn("c", (F.col("p") >= 0.5).cast("int"))
    one = models.accuracy(x, "y", "c").join(F.broadcast(models.log_loss(x, "y", F.col("p")))).join(F.broadcast(models.macro_f1(x, "y", "c")))
    return one.select("accuracy", "log_loss", "macro_f1")


@query("""WITH x AS (SELECT l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS r FROM lineitem), g AS (SELECT count(r)::DOUBLE AS n, avg(r * r) AS v FROM x)
SELECT -n / 2 * (ln(2 * pi() * v) + 1) AS log_likelihood, 4 + n * (ln(2 * pi() * v) + 1) AS aic, 2 * ln(n) + n * (ln(2 * pi() * v) + 1) AS bic FROM g""")
def information_criteria(s, d):
    x = t(s, d, "lineitem")
    mean = F.broadcast(x.agg(F.avg("l_extendedprice").alias("m")))  # one row
    return models.information_criteria(x.join(mean).select((F.col("l_extendedprice") - F.col("m")).alias("r")), "r", 2)
