"""Graphs as edges (src, dst, w): joins and aggregates a round, materialised between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import discard, materialise


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    u = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return u.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) after a fixed number of rounds; weights divide a node's rank, rank of sinks goes to all nodes."""
    edges = materialise(edges.select("src", "dst", "w"), "edges")
    out = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    e = materialise(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("p")))
    v = materialise(nodes(edges), "nodes")
    n = v.count()
    r = materialise(v.withColumn("rank", F.lit(1.0 / max(n, 1))))
    sinks = materialise(v.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    for _ in range(rounds):
        # ranks of the last round, with what sinks lose beside them, in one job a round
        lost = F.broadcast(r.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        got = r.join(e, r.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        new = r.select("id").join(got, "id", "left").join(lost).select("id", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        old, r = r, materialise(new)
        discard(old)
    discard(e, edges, sinks)
    return r


def shortest_paths(edges: DataFrame, source, most_rounds: int = 100, hops: int | None = None) -> DataFrame:
    """(id, distance) of the nodes that source reaches, by rounds of relaxation; weights may be negative, negative cycles fail.
    hops: paths of that many edges at most."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    d = spark.createDataFrame([(source, 0.0)], f"id {kind}, distance double")
    last = (1, 0.0)
    for _ in range(most_rounds if hops is None else hops):
        step = d.join(edges, d.id == edges.src).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"))
        d = materialise(d.union(step).groupBy("id").agg(F.min("distance").alias("distance")))
        now = tuple(d.agg(F.count("*"), F.sum("distance")).first())
        if now == last:
            return d
        last = now
    if hops is not None:
        return d
    raise RuntimeError(f"distances have not settled in {most_rounds} rounds: a negative cycle, or a longer path")
