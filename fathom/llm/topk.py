"""Exact top-k by inner product with norm-bucketed retrieval.

Components become integers floor(scale * x). Vectors are grouped by length: a bucket is a class of nearly equal norms
(a log grid), cut by a hash of the id into blocks of about BLOCK_ROWS rows, so a class that holds a third of all rows is
many blocks. A first pass against the SEEDS longest vectors gives every query a lower bound t on its k-th score. A query
block then visits only classes whose norms can reach it. In a block, the local cosine threshold t / (|q| * longest norm)
decides: over 1, the block is skipped for that query; high, coordinate pruning (the query's largest coordinate bounds the
cosine) chooses candidates; low, length pruning takes the prefix of rows that are long enough. What is left is verified
by whole products, which are exact: in doubles while all sums fit 53 bits, in longs up to 62, else in Python integers.

Ties go to the smaller id. Vectors that are null, empty, or hold null or non-finite components, and null ids, take no
part. Vectors of different dimension are not compared. Repeated rows (same id and vector) count once; a repeated id
with another vector is a query and a candidate of its own, never a candidate of its own id. A score that no
long can hold is shown as the nearest long but one of the smallest, and such scores are ranked by their value as doubles.
Components whose product with scale is beyond the doubles count as the largest double. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.session import materialise, ship

SCALE, K, BLOCK_ROWS, QUERY_ROWS, SEEDS = 64, 20, 4096, 512, 1024
LARGEST = float(np.finfo(np.float64).max)
#: Norm classes an octave, and the local cosine threshold from which coordinates prune.
PER_OCTAVE, COORDINATE_FROM = 8, 0.8


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of lists: the rows that take part, where each begins in the third (one more at the end), and
    floor(scale * x) of all their components, whole numbers as doubles."""
    n = len(column)
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(int(offs[0]), int(offs[-1] - offs[0])) if n else column.values.slice(0, 0)
    offs = offs - offs[0] if n else np.zeros(1, np.int64)
    x = np.array(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
    ok = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    use = (np.diff(offs) > 0) & (ok[offs[1:]] == ok[offs[:-1]])
    if column.null_count:
        use &= column.is_valid().to_numpy(zero_copy_only=False)
    own = np.flatnonzero(use)
    size = np.diff(offs)[own]
    at = np.repeat(offs[own] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(own) else offs[:0], size) + np.arange(size.sum())
    with np.errstate(over="ignore"):
        y = np.floor(scale * x[at])
    return own, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.clip(y, -LARGEST, LARGEST)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows of x, at most LARGEST."""
    most = np.abs(x).max(1, initial=0.0)
    with np.errstate(over="ignore"):
        return np.minimum(np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)) * most, LARGEST)


def exact_products(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q @ c.T of whole numbers given as doubles, without rounding: as longs, where what no long can hold is the nearest
    long, and as doubles."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64), np.zeros((len(q), len(c)))
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if most < 2.0**53:
        out = q @ c.T
        return out.astype(np.int64), out
    if most < 2.0**62 and np.abs(q).max() < 2.0**62 and np.abs(c).max() < 2.0**62:
        out = q.astype(np.int64) @ c.T.astype(np.int64)
        return out, out.astype(np.float64)
    whole = np.frompyfunc(int, 1, 1)
    out = (whole(q) @ whole(c).T).reshape(len(q), len(c))
    top = (1 << 63) - 1
    return np.frompyfunc(lambda v: max(-top, min(top, v)), 1, 1)(out).astype(np.int64), np.frompyfunc(_double, 1, 1)(out).astype(np.float64)


def _double(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def best(scores: np.ndarray, wide: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores (equal ones by wide), ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -wide[at], -scores[at]))[:k]]


def search_block(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query index, candidate indices, scores as longs and as doubles): each query's best of one block whose score is at least its bound.
    The block's rows come longest first."""
    q_norm, c_norm = norms(q), norms(c)
    slack = 1 - 1e-9
    longest = c_norm[0]
    with np.errstate(over="ignore"):
        reach = q_norm * longest
    local = np.where(bound <= 0, -1.0, np.divide(bound * slack, reach, out=np.full(len(q), np.inf), where=reach > 0))
    out = []
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1))
    unit = c / np.where(c_norm > 0, c_norm, 1)[:, None] if len(by_coordinate) else None
    for i in by_coordinate.tolist():
        f = int(np.abs(q[i]).argmax())
        a, b = q[i, f] / q_norm[i], unit[:, f]
        could = a * b + np.sqrt(np.maximum(0, 1 - a * a)) * np.sqrt(np.maximum(0, 1 - b * b)) + 1e-9
        at = np.flatnonzero((could > 0) & (could * c_norm >= bound[i] * slack / q_norm[i]) & (c_ids != q_ids[i]))
        s, wide = (x[0] for x in exact_products(q[i : i + 1], c[at]))
        ok = s >= bound[i]
        at, s, wide = at[ok], s[ok], wide[ok]
        top = best(s, wide, c_ids[at], k)
        out.append((i, at[top], s[top], wide[top]))
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    if len(by_length):
        need = np.where(bound[by_length] > 0, bound[by_length] * slack / np.maximum(q_norm[by_length], 1e-300), -1.0)
        upto = int(np.searchsorted(-c_norm, -need.min(), "right"))
        products, doubles = exact_products(q[by_length], c[:upto])
        for row, i in enumerate(by_length.tolist()):
            at = np.flatnonzero((products[row] >= bound[i]) & (c_ids[:upto] != q_ids[i]))
            s, wide = products[row][at], doubles[row][at]
            top = best(s, wide, c_ids[at], k)
            out.append((i, at[top], s[top], wide[top]))
    return out


def vectors(df: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, norm, v: components as doubles, in binary) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            own, begin, x = integers(b.column(1), scale)
            size = np.diff(begin)
            most = np.maximum.reduceat(np.abs(x), begin[:-1]) if len(own) else np.zeros(0)
            share = x / np.repeat(np.where(most > 0, most, 1), size)
            with np.errstate(over="ignore"):
                norm = np.minimum(np.sqrt(np.add.reduceat(share * share, begin[:-1])) * most, LARGEST) if len(own) else most
            v = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer((begin * 8).tobytes()), pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(size, pa.int32()), pa.array(norm), v], names=["id", "dim", "norm", "v"])

    return df.select(F.col(id).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id long, dim int, norm double, v binary")


def top_k(df: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where queries holds, its k best other rows."""
    spark = df.sparkSession
    ship(spark)
    c = materialise(vectors(df, id, vector, scale).withColumn("cls", F.coalesce(F.floor(F.log2("norm") * PER_OCTAVE), F.lit(-1)).cast("int")), "vectors")
    # a row a norm class and dimension: the classes of doubles from 1 on are 8,200 at most
    classes = c.groupBy("dim", "cls").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    salts = {(r.dim, r.cls): (max(1, -(-r.n // BLOCK_ROWS)), r.longest) for r in classes}
    salt_of = F.create_map(*(x for (d, s), (n, _) in salts.items() for x in (F.lit(f"{d}/{s}"), F.lit(n)))) if salts else F.create_map(F.lit(""), F.lit(1))
    blocks = c.withColumn("salt", F.pmod(F.xxhash64("id"), salt_of[F.concat_ws("/", "dim", "cls")]).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("norm").to_numpy(), kind="stable")
        t = table.take(pa.array(order))
        return pa.table({"dim": t.column("dim").slice(0, 1), "cls": t.column("cls").slice(0, 1), "salt": t.column("salt").slice(0, 1), "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "vs": pa.array([b"".join(t.column("v").to_pylist())], pa.binary())})

    blocks = blocks.groupBy("dim", "cls", "salt").applyInArrow(pack, "dim int, cls int, salt int, ids binary, vs binary")

    seeds = c.orderBy(F.col("norm").desc(), "id").limit(SEEDS).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == d]
        by_dim[d] = (np.array([r.id for r in own], np.int64), _matrix([bytes(r.v) for r in own], d))

    q = df.where(queries)
    q = vectors(q, id, vector, scale).dropDuplicates(["id", "v"])
    n_queries = df.where(queries).count()
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_queries // QUERY_ROWS + 1)))

    def bounds(table: pa.Table) -> pa.Table:
        """A query block with each query's bound, once for every candidate block it must visit."""
        dim = table.column("dim")[0].as_py()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v").to_pylist(), dim)
        bound = np.full(len(ids), -(1 << 62), np.int64)
        if dim in by_dim and len(by_dim[dim][0]) > k:
            seed_ids, seed = by_dim[dim]
            s = exact_products(v, seed)[0]
            s[ids[:, None] == seed_ids[None, :]] = -(1 << 62)
            # a repeated seed row must not raise the bound twice
            u = np.unique(np.concatenate([seed_ids.view(np.float64)[:, None], seed], 1).view(np.int64), axis=0, return_index=True)[1]
            s = s[:, np.sort(u)]
            if s.shape[1] > k:
                bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        norm = norms(v)
        least = np.where(bound > 0, bound * (1 - 1e-9) / np.maximum(norm, 1e-300), -1.0).min()
        to = [(cls, x) for (d, cls), (n, longest) in salts.items() if d == dim and longest >= least for x in range(n)]
        m = len(to)
        raw = [pa.array([x.tobytes()] * m, pa.binary()) for x in (ids, v, bound)]
        return pa.table({"dim": pa.array([dim] * m, pa.int32()), "cls": pa.array([x for x, _ in to], pa.int32()), "salt": pa.array([x for _, x in to], pa.int32()), "q_ids": raw[0], "q": raw[1], "bound": raw[2]})

    visits = q.groupBy("dim", "qb").applyInArrow(bounds, "dim int, cls int, salt int, q_ids binary, q binary, bound binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, c_ids, bound = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "ids", "bound"))
                found = search_block(_matrix([r["q"]], r["dim"]), q_ids, bound, _matrix([r["vs"]], r["dim"]), c_ids, k)
                which = np.concatenate([np.full(len(x[1]), x[0]) for x in found]) if found else np.zeros(0, np.int64)
                at, s, wide = (np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (1, 2, 3))
                which, at = which.astype(np.int64), at.astype(np.int64)
                # tells queries apart that share an id (they are in one block)
                q_hash = [zlib.crc32(r["q"][8 * r["dim"] * i : 8 * r["dim"] * (i + 1)]) for i in range(len(q_ids))] if len(set(q_ids.tolist())) < len(q_ids) else [0] * len(q_ids)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[which]), pa.array(np.array(q_hash, np.int64)[which]), pa.array(c_ids[at]), pa.array(s.astype(np.int64)), pa.array(wide)], names=["query_id", "twin", "vec_id", "score", "wide"])

    # few rows, all heavy: one block pair an Arrow batch would do, and small batches bound memory
    pairs = visits.join(blocks, ["dim", "cls", "salt"]).select("dim", "q_ids", "q", "bound", "ids", "vs")
    found = pairs.mapInArrow(search, "query_id long, twin long, vec_id long, score long, wide double").distinct()
    order = W.partitionBy("query_id", "twin").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
