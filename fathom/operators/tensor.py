"""Tensors as rows (i0, i1, ..., v), absent entries zero; matrix algebra and solvers on (i, j, v) rows beyond products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.errors import need
from fathom.operators.matrix import spmv
from fathom.session import discard, materialise


def axes(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "v"]


def permute(a: DataFrame, order: list[int]) -> DataFrame:
    """Axis k of the result is axis order[k] of a."""
    names = axes(a)
    need(sorted(order) == list(range(len(names))), "order is a permutation of the axes")
    return a.select(*(F.col(names[o]).alias(f"i{k}") for k, o in enumerate(order)), "v")


def _named(a: DataFrame, prefix: str) -> DataFrame:
    return a.select(*(F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(axes(a))), F.col("v").alias(f"{prefix}v"))


def contract(a: DataFrame, b: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Sum of products over the paired axes: an equi-join and an aggregate. Axes left over keep their order, a's first."""
    need(len(pairs) > 0, "at least one pair of axes; see outer")
    x, y = _named(a, "_a"), _named(b, "_b")
    on = [F.col(f"_a{p}") == F.col(f"_b{q}") for p, q in pairs]
    left = [f"_a{k}" for k in range(len(axes(a))) if k not in {p for p, _ in pairs}] + [f"_b{k}" for k in range(len(axes(b))) if k not in {q for _, q in pairs}]
    j = x.join(y, on).withColumn("_p", F.col("_av") * F.col("_bv"))
    return j.groupBy(*(F.col(c).alias(f"i{k}") for k, c in enumerate(left))).agg(F.sum("_p").alias("v"))


def outer(a: DataFrame, vector: list[float]) -> DataFrame:
    """a with one more axis: product with a small vector, whose values become part of the plan."""
    need(len(vector) <= 10_000, "the vector has at most 10,000 values; contract with a unit axis beyond")
    n = len(axes(a))
    e = a.select("*", F.posexplode(F.array(*map(F.lit, map(float, vector)))).alias("_k", "_w")).where("_w <> 0")
    return e.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(axes(a))), F.col("_k").alias(f"i{n}"), (F.col("v") * F.col("_w")).alias("v"))


def reduce_axis(a: DataFrame, axis: int, how: str = "sum") -> DataFrame:
    """Sum, max, min or mean over one axis, of the entries that exist."""
    keep = [c for k, c in enumerate(axes(a)) if k != axis]
    return a.groupBy(*(F.col(c).alias(f"i{k}") for k, c in enumerate(keep))).agg(getattr(F, {"mean": "avg"}.get(how, how))("v").alias("v"))


def argmax_axis(a: DataFrame, axis: int) -> DataFrame:
    """(other axes, position): place of the largest entry, ties to the smaller place."""
    names = axes(a)
    keep = [c for k, c in enumerate(names) if k != axis]
    return a.groupBy(*(F.col(c).alias(f"i{k}") for k, c in enumerate(keep))).agg(F.max_by(names[axis], F.struct("v", -F.col(names[axis]))).alias("position"))


def softmax_axis(a: DataFrame, axis: int) -> DataFrame:
    """Over the entries that exist along one axis, shifted by their largest."""
    keep = [c for k, c in enumerate(axes(a)) if k != axis]
    m = a.groupBy(*keep).agg(F.max("v").alias("_m")) if keep else a.agg(F.max("v").alias("_m"))
    e = (a.join(m, keep) if keep else a.join(F.broadcast(m))).withColumn("_e", F.exp(F.col("v") - F.col("_m")))
    t = e.groupBy(*keep).agg(F.sum("_e").alias("_t")) if keep else e.agg(F.sum("_e").alias("_t"))
    e = e.join(t, keep) if keep else e.join(F.broadcast(t))
    return e.select(*axes(a), (F.col("_e") / F.col("_t")).alias("v"))


def slice_axis(a: DataFrame, axis: int, low: int, high: int) -> DataFrame:
    """Places low to high - 1 of an axis, counted from zero afterwards."""
    c = axes(a)[axis]
    return a.where(F.col(c).between(low, high - 1)).withColumn(c, F.col(c) - low)


def concatenate(a: DataFrame, b: DataFrame, axis: int, size: int) -> DataFrame:
    """b after a along an axis of which a has `size` places."""
    c = axes(a)[axis]
    return a.unionByName(b.withColumn(c, F.col(c) + size))


def elementwise(a: DataFrame, f) -> DataFrame:
    """f on every entry that exists; f(0) has to be 0 for this to be the map of the whole tensor."""
    return a.withColumn("v", f(F.col("v"))).where("v <> 0")


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    names = axes(a)
    return a.join(b.withColumnRenamed("v", "_w"), names).select(*names, (F.col("v") * F.col("_w")).alias("v"))


def kron_block(a: DataFrame, block: list[list[float]]) -> DataFrame:
    """Kronecker product of a matrix with a small dense block."""
    rows, cols = len(block), len(block[0])
    need(rows * cols <= 10_000, "the block has at most 10,000 entries")
    cells = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for r, row in enumerate(block) for c, w in enumerate(row) if w))
    e = a.select("i", "j", "v", F.explode(cells).alias("_b"))
    return e.select((F.col("i") * rows + F.col("_b.r")).alias("i"), (F.col("j") * cols + F.col("_b.c")).alias("j"), (F.col("v") * F.col("_b.w")).alias("v"))


def norm(a: DataFrame, p: float = 2.0) -> DataFrame:
    power = F.pow(F.sum(F.pow(F.abs("v"), F.lit(float(p)))), F.lit(1 / p))
    return a.agg((F.coalesce(F.max(F.abs("v")), F.lit(0.0)) if p == float("inf") else F.coalesce(power, F.lit(0.0))).alias("norm"))


def _dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.withColumnRenamed("v", "_w"), "i").agg(F.sum(F.col("v") * F.col("_w"))).first()[0] or 0.0


def _axpy(x: DataFrame, y: DataFrame, k: float) -> DataFrame:
    """x + k y."""
    u = x.select("i", "v").union(y.select("i", (F.col("v") * k).alias("v")))
    return u.groupBy("i").agg(F.sum("v").alias("v"))


def conjugate_gradient(a: DataFrame, b: DataFrame, rounds: int = 200, tol: float = 1e-10, diagonal: bool = True) -> tuple[DataFrame, dict]:
    """Solves a x = b for a symmetric positive definite matrix, b(i, v); with diagonal preconditioning unless told otherwise.

    A round is one sparse product, two sums and three vector updates; the matrix is written out once, vectors between rounds
    for as long as they are read, so that a lost executor costs one round.
    """
    a = materialise(a.select("i", "j", "v"), "matrix")
    inverse = materialise(a.where(F.col("i") == F.col("j")).select("i", (1 / F.col("v")).alias("_d"))) if diagonal else None

    def scaled(r: DataFrame) -> DataFrame:
        return materialise(r.join(inverse, "i").select("i", (F.col("v") * F.col("_d")).alias("v"))) if diagonal else r

    r = materialise(b.select("i", F.col("v").cast("double").alias("v")))
    x = materialise(r.select("i", F.lit(0.0).alias("v")))
    size = _dot(r, r) ** 0.5
    z = scaled(r)
    p, rz, left, told = z, _dot(r, z), size, {"rounds": 0, "residual": 0.0, "converged": True}
    for k in range(1, rounds + 1) if size else ():
        q = materialise(spmv(a, p))
        curve = _dot(p, q)
        if curve <= 0:
            discard(q)
            told = {"rounds": k, "residual": left / size, "converged": False}
            break
        step, old = rz / curve, (x, r, q, *((z,) if diagonal and z is not p else ()))
        x, r = materialise(_axpy(x, p, step)), materialise(_axpy(r, q, -step))
        # without scaling the first p is r itself
        discard(*(t for t in old if t is not p))
        left = _dot(r, r) ** 0.5
        told = {"rounds": k, "residual": left / size, "converged": left <= tol * size}
        if told["converged"]:
            break
        z = scaled(r)
        new, old = _dot(r, z), p
        p, rz = materialise(_axpy(z, p, new / rz)), new
        discard(old)
    discard(a, *(t for t in {id(t): t for t in (inverse, r, z, p)}.values() if t is not None))
    return x, told


def minimum_spanning_forest(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(src, dst, w) of the lightest edges that join all that can be joined: Boruvka's rounds, each at least halving the trees.

    Ties go to smaller ends. In a round every tree takes its lightest leaving edge; pairs that took the same edge are
    rooted at the smaller label, and labels then double their reach until they are roots.
    """
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w")).where("src <> dst")
    e = materialise(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    label = materialise(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("tree", F.col("id")))
    kept = None
    for _ in range(most_rounds):
        a = e.join(label.select(F.col("id").alias("src"), F.col("tree").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("tree").alias("b")), "dst").where("a <> b")
        order = F.struct("w", "src", "dst")
        sides = a.select(F.col("a").alias("tree"), F.col("b").alias("to"), order.alias("e")).union(a.select("b", "a", order))
        best = materialise(sides.groupBy("tree").agg(F.min(F.struct("e", "to")).alias("m")).select("tree", "m.e", "m.to"))
        if best.isEmpty():
            break
        chosen = best.select("e.src", "e.dst", "e.w").distinct()
        kept = materialise(chosen if kept is None else kept.union(chosen).distinct())
        other = best.select(F.col("tree").alias("to"), F.col("to").alias("_back"))
        parent = best.join(other, "to", "left").select("tree", F.when((F.col("_back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("up"))
        parent = materialise(parent)
        while True:
            above = parent.select(F.col("tree").alias("up"), F.col("up").alias("_u"))
            further = materialise(parent.join(above, "up", "left").select("tree", F.coalesce("_u", "up").alias("up")))
            moved = further.join(parent.withColumnRenamed("up", "_was"), "tree").where("up <> _was").isEmpty()
            parent = further
            if moved:
                break
        label = materialise(label.join(parent, "tree", "left").select("id", F.coalesce("up", "tree").alias("tree")))
    return kept if kept is not None else e.limit(0)


def top_entries(a: DataFrame, k: int) -> DataFrame:
    """The k entries of largest size, ties by place."""
    return a.orderBy(F.abs("v").desc(), *axes(a)).limit(k)


def rank_entries(a: DataFrame, axis: int, descending: bool = True) -> DataFrame:
    """Rank of an entry along one axis."""
    names = axes(a)
    keep = [c for n, c in enumerate(names) if n != axis]
    v: Column = F.col("v").desc() if descending else F.col("v").asc()
    return a.withColumn("rank", F.row_number().over(W.partitionBy(*keep).orderBy(v, names[axis])))
