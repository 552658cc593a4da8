"""Queries of the tensor module and its solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.catalog import _EDGES, _edges, query, t
from fathom.operators import tensor
from fathom.session import materialise


def _sales(s, d) -> DataFrame:
    """Quantity by return flag and status codes, line number and tax in hundredths."""
    code = lambda c: F.ascii(c).alias(f"i{0 if c == 'l_returnflag' else 1}")
    g = t(s, d, "lineitem").groupBy(code("l_returnflag"), code("l_linestatus"), F.col("l_linenumber").cast("int").alias("i2"))
    return g.agg(F.sum("l_quantity").cast("double").alias("v"))


_SALES = "WITH a AS (SELECT ascii(l_returnflag) AS i0, ascii(l_linestatus) AS i1, l_linenumber::INTEGER AS i2, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"


@query(_SALES + " SELECT x.i0 AS i0, y.i0 AS i1, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.i1 = y.i1 AND x.i2 = y.i2 GROUP BY ALL")
def tensor_contract(s, d):
    a = _sales(s, d)
    return tensor.contract(a, a, [(1, 1), (2, 2)])


@query(_SALES + " SELECT i0, i1, max(v) AS v FROM a GROUP BY ALL")
def tensor_reduce(s, d):
    return tensor.reduce_axis(_sales(s, d), 2, "max")


@query(_SALES + " SELECT i0, i1, arg_max(i2, struct_pack(v := v, k := -i2)) AS position FROM a GROUP BY ALL")
def tensor_argmax(s, d):
    return tensor.argmax_axis(_sales(s, d), 2)


@query(_SALES + ", b AS (SELECT i0, i1, i2, v / 100000 AS v FROM a), m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY i0, i1)) AS e FROM b) SELECT i0, i1, i2, e / sum(e) OVER (PARTITION BY i0, i1) AS v FROM m")
def tensor_softmax(s, d):
    return tensor.softmax_axis(_sales(s, d).withColumn("v", F.col("v") / 100000), 2)


@query(_SALES + " SELECT i2 AS i0, i0 AS i1, i1 AS i2, k AS i3, v * w AS v FROM a, (VALUES (0, 0.5::DOUBLE), (2, 2.0::DOUBLE)) x(k, w)")
def tensor_outer(s, d):
    return tensor.outer(tensor.permute(_sales(s, d), [2, 0, 1]), [0.5, 0.0, 2.0])


@query("WITH a AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT i * 2 + r AS i, j * 2 + c AS j, v * w AS v FROM a, (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0::DOUBLE), (1, 1, 3.0::DOUBLE)) b(r, c, w)")
def kron_block(s, d):
    a = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").cast("double").alias("v"))
    return tensor.kron_block(a, [[1, 2], [0, 3]])


@query(f"WITH {_EDGES} SELECT pow(sum(pow(w, 3)), 1.0 / 3) AS norm FROM e")
def tensor_norm(s, d):
    return tensor.norm(_edges(s, d).select(F.col("src").alias("i0"), F.col("dst").alias("i1"), F.col("w").alias("v")), 3.0)


@query()
def conjugate_gradient(s, d):
    """Laplacian of the trade graph plus one on the diagonal, against the degrees."""
    e = materialise(_edges(s, d), "edges")
    u = materialise(e.union(e.select("dst", "src", "w")).groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w")))
    a = u.select("i", "j", (-F.col("w")).alias("v")).union(u.groupBy("i").agg(F.sum("w").alias("s")).select("i", F.col("i").alias("j"), F.col("s") + 1))
    return tensor.conjugate_gradient(a, u.groupBy("i").agg(F.count("*").cast("double").alias("v")))[0]


@query()
def minimum_spanning_forest(s, d):
    return tensor.minimum_spanning_forest(_edges(s, d))
