"""Connected components by alternating star contraction, without collecting links or nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import discard, materialise, ship

#: Links (16 bytes each) that one task contracts at most; beyond, rounds over all executors.
ONE_TASK = 1 << 20


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component among these links), for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[out], nodes[root[out]]


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links that is not its component's smallest node; root is that smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, under its smallest neighbour. Smallest
    neighbours are partial aggregates and are written before the join, so a hub's links can be split between tasks.
    Links with a null end are ignored; repeated links and loops do no harm. Once there are at most ONE_TASK links, at the
    start or after a round, one task finishes the work.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialise(e, "links")
    state = _state(e)
    for _ in range(most_rounds):
        if state[0] <= ONE_TASK:
            return _finished(e)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # u's smaller neighbours and u itself go under the smallest
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, materialise(hung.distinct(), "links")
        discard(old, large, low, least)
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _finished(links: DataFrame) -> DataFrame:
    """The same for a table of at most ONE_TASK links (u, v)."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        a, b = (np.concatenate([p.column(k).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        node, root = local_forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

    return links.coalesce(1).select("u", "v").mapInArrow(run, "node long, root long")
