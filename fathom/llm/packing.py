"""Packing into fixed-length sequences by cutting-stock column generation.

Every document is encoded and ends with an id. Its tokens are cut into full pieces of `capacity` tokens, each a sequence
of its own, and one shorter rest. The histogram of the rests, in classes of UNIT tokens (rounded up), is a cutting-stock
problem: how many sequences of which pattern (how many rests of each class)? A linear program over patterns is solved by
column generation, a knapsack over class sizes prices new patterns, and rounded-down patterns plus first-fit
decreasing for what rounding leaves cover all rests. Rests are ranked in their class, and a rank gives sequence and slot.

The histogram has at most capacity / UNIT rows whatever the size of the corpus, so the program runs on the driver. It
starts from first-fit-decreasing patterns; one knapsack table prices a batch of patterns, one for each size it must hold,
and these enter the basis while they pay. It ends within GAP of its lower bound; if ROUNDS tables do not get there, a
warning gives the gap, and the packing is valid all the same. Ranks come from counts by (input partition, class) and
running sums, so no class has to meet in one task; a table read in the same partitions is packed the same way each time.

Padding: a full sequence needs none. Other sequences are as full as the program makes them; a sequence whose length is a
power of two needs none either, and no pattern aims at that: one below the capacity would leave half of it empty, which
takes more sequences than the padding it saves.

Null text counts as empty: a document of the end id alone. Each row is a document, repeated ids too. Other columns may
have any names.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.llm.tokens import encoder, vocabulary
from fathom.session import give_back, materialise, ship

CAPACITY, UNIT = 4096, 8
#: Column generation ends when the program is this near to its lower bound, or after so many knapsacks.
GAP, ROUNDS = 4e-3, 4000
#: Patterns priced by one knapsack table.
BATCH = 96


class Knapsack:
    """Unbounded knapsack by dynamic programming over all capacities up to one."""

    def __init__(self, value: np.ndarray, size: np.ndarray, capacity: int):
        self.value, self.size, self.capacity = value, size, capacity
        use = np.flatnonzero(value > 1e-12)
        order = use[np.argsort(size[use], kind="stable")]
        w, v = size[order], value[order]
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(w, np.arange(capacity + 1), "right").tolist()
        back = (-w).tolist()
        for c in range(back and -back[0] or capacity + 1, capacity + 1):
            best[c] = best[c - 1]
            x = best[c - w[: upto[c]]] + v[: upto[c]]
            i = x.argmax()
            if x[i] > best[c] + 1e-15:
                best[c], took[c] = x[i], i
        self.best, self.took, self.order = best, took, order

    def most(self) -> float:
        return float(self.best[self.capacity])

    def holding(self) -> np.ndarray:
        """The value of the best pattern that holds each item."""
        return self.value + self.best[self.capacity - self.size]

    def pattern(self, item: int | None = None) -> np.ndarray:
        """How often the best pattern (that holds item) takes each item."""
        count = np.zeros(len(self.value), np.int64)
        c = self.capacity
        if item is not None:
            count[item] += 1
            c -= int(self.size[item])
        while c > 0:
            if self.took[c] < 0:
                c -= 1
            else:
                i = self.order[self.took[c]]
                count[i] += 1
                c -= int(self.size[i])
        return count


def _first_fit(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each size a pattern that begins with as many of it as fit and takes the largest that still fit then."""
    out = []
    by = np.argsort(-size, kind="stable")
    for i in range(len(size)):
        c = np.zeros(len(size), np.int64)
        c[i] = max(1, min(capacity // size[i], int(demand[i])))
        room = capacity - int(c[i] * size[i])
        for k in by.tolist():
            if k < i and size[k] <= room and demand[k]:
                n = min(room // int(size[k]), int(demand[k]))
                c[k] += n
                room -= n * int(size[k])
        out.append(c)
    return out


def cutting_stock(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns (items of each size) and how often each is used, covering demand exactly; and a lower bound on their number.
    Sizes ascend."""
    n = len(size)
    if not n:
        return [], 0.0
    columns = [np.where(np.arange(n) == i, capacity // size[i], 0).astype(float) for i in range(n)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(n)])
    x = demand / np.array([columns[i][i] for i in range(n)])
    bound, pivots, good = 0.0, 0, False
    pool = np.array(_first_fit(size, demand, capacity), float)
    for _ in range(rounds):
        while len(pool):
            # the pattern of the pool that pays most enters the basis
            worth = np.einsum("ij,j->i", pool, inverse.sum(0))
            at = int(worth.argmax())
            if worth[at] <= 1 + 1e-6:
                break
            new, pool = pool[at].copy(), np.delete(pool, at, 0)
            step = np.einsum("ij,j->i", inverse, new)  # small: threads of a matrix library would cost more than they give
            up = np.flatnonzero(step > 1e-9)
            ratio = x[up] / step[up]
            out = up[int(ratio.argmin())]
            t = max(0.0, float(ratio.min()))
            x = x - t * step
            x[out] = t
            columns[out] = new
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
            pivots += 1
            if pivots % 200 == 0:  # numerical drift
                inverse = np.linalg.inv(np.array(columns).T)
                x = np.maximum(inverse @ demand, 0)
        table = Knapsack(inverse.sum(0), size, capacity)
        bound = max(bound, x.sum() / max(table.most(), 1.0))
        good = table.most() <= 1 + 1e-9 or x.sum() - bound <= gap * bound
        if good:
            break
        holding = table.holding()
        best = np.argsort(-holding, kind="stable")[:BATCH]
        pool = np.unique(np.array([table.pattern(), *(table.pattern(int(i)) for i in best if holding[i] > 1 + 1e-6)], float), axis=0)
    if not good:
        warnings.warn(f"packing stopped after {rounds} rounds: {x.sum():.1f} sequences, at least {bound:.1f} are needed", stacklevel=2)
    left = demand.copy()
    used: list[tuple[np.ndarray, int]] = []
    for column, many in zip(columns, x, strict=True):
        c = column.astype(np.int64)
        many = int(many + 1e-6)
        if many and c.any():
            many = min(many, int((left[c > 0] // c[c > 0]).min()))
            if many > 0:
                used.append((c, many))
                left -= many * c
    # what rounding leaves: first fit decreasing
    bins: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-size, kind="stable").tolist():
        for _ in range(int(left[i])):
            for k, (room, c) in enumerate(bins):
                if room >= size[i]:
                    c[i] += 1
                    bins[k] = (room - int(size[i]), c)
                    break
            else:
                c = np.zeros(n, np.int64)
                c[i] = 1
                bins.append((capacity - int(size[i]), c))
    return used + [(c, 1) for _, c in bins], bound


_PIECE = "part int, cls int, nth long, doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int = 2, drops_space: bool = True, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pieces with their ids, written to the shared folder. part and nth: rank within an input partition and class; class 0: full."""
    ship(docs.sparkSession)
    vocab = vocab or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(vocab, drops_space), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit + 2, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in range(8)]
                for i, raw in zip(b.column(0).slice(at, 256).to_pylist(), enc.ids_of(b.column(1).slice(at, 256).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        own = raw[4 * start : 4 * (start + capacity)]
                        length = len(own) // 4
                        cls = 0 if length == capacity else -(-length // unit)
                        for column, x in zip(out, (cls, int(seen[cls]), i, start, length, own, zlib.crc32(own), n), strict=True):
                            column.append(x)
                        seen[cls] += 1
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["part", "cls", "nth", "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])
        # the worker waits for other stages' tasks too; a task fills its cache by itself
        enc.forget()
        give_back()

    return materialise(docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _PIECE), "pieces")


def assign(made: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces()."""
    by_part = materialise(made.groupBy("part", "cls").agg(F.count("*").alias("n")), "counts")
    counts = {r.cls: r.n for r in by_part.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # capacity / unit + 1 rows at most
    classes = np.array(sorted(c for c in counts if c), np.int64)
    used, _ = cutting_stock(classes, np.array([counts[c] for c in classes.tolist()], np.int64), capacity // unit)
    # for each class: first rank of each pattern that holds it, items a sequence, first sequence
    tables: dict[int, list[tuple[int, int, int]]] = {0: [(0, 1, sum(m for _, m in used))]}
    ranked, first = dict.fromkeys(classes.tolist(), 0), 0
    for column, many in used:
        for k in np.flatnonzero(column).tolist():
            c = int(classes[k])
            tables.setdefault(c, []).append((ranked[c], int(column[k]), first))
            ranked[c] += int(column[k]) * many
        first += many
    arrays = {c: np.array(x, np.int64).T for c, x in tables.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = b.column(b.schema.get_field_index("cls")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls).tolist():
                at = np.flatnonzero(cls == c)
                starts, each, seq = arrays[c]
                k = np.searchsorted(starts, rank[at], "right") - 1
                sequence[at] = seq[k] + (rank[at] - starts[k]) // each[k]
                slot[at] = (rank[at] - starts[k]) % each[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], names=[*b.schema.names, "sequence_id", "slot"])

    before = by_part.select("part", "cls", (F.sum("n").over(W.partitionBy("cls").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    meta = made.drop("ids").join(before, ["part", "cls"]).withColumn("rank", F.col("nth") + F.col("before")).drop("before")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in meta.schema)
    placed = meta.mapInArrow(run, f"{fields}, sequence_id long, slot long")
    order = W.partitionBy("sequence_id").orderBy(F.col("cls").desc(), "slot").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", with_ids: bool = False, vocab: str | None = None, end_id: int = 2, drops_space: bool = True, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: its ids too."""
    made = pieces(docs, id, text, vocab, end_id, drops_space, capacity, unit)
    placed = assign(made, capacity, unit)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        key = ["part", "cls", "nth"]
        placed = placed.join(made.select(*key, "ids"), key)
        columns.append("ids")
    return placed.select(*columns)
