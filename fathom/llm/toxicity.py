"""Toxicity from class-conditional Kneser-Ney models.

Words (runs of letters; A-Z lower-cased, bytes from 0x80 on are letters) of the labelled training documents are counted
by class. From these counts two character models of order ORDER are made, over each word with its start and end marks:

    p_c(x|h) = max(n_c(hx) - D, 0) / n_c(h) + D * N_c(h.) / n_c(h) * p(x|h')

The class's own counts serve at the longest history only. Below it stands one backoff shared by both classes, of
Kneser-Ney continuation counts (how many characters come before), so a rare expression that neither class has seen
enough of gets the same probability from both and tells nothing. A document's evidence is the difference of its
length-normalised toxic and ordinary log-likelihoods, a mean over words: over the whole text, and over the window of
WINDOW words where it is highest. A logistic curve, fitted on labelled rows kept out of the counts, turns both into a score.

Labels are read for rows whose crc32(id as text) mod 4 is not 2: remainders 0 and 1 count, remainder 3 calibrates. Counts
cover all of these labelled documents, and every distinct n-gram (by its 64-bit hash) has a row of its own, so the model
grows with their number. It is collected and broadcast whole, at 40 bytes an n-gram at most. Bound, as a parameter:
CALIBRATION_ROWS labelled rows for the curve, chosen by hash of their id.

Null and empty texts have no evidence and get the curve's value at zero. Without labels of both classes the score is the
share of toxic labels, (toxic + 1) / (labelled + 2). Repeated ids are scored row by row; a repeated label row counts once
for each label it gives. Rows with a null id are scored and never held out. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import text as X
from fathom.session import materialise, ship

ORDER, WINDOW, DISCOUNT = 5, 8, 0.75
CALIBRATION_ROWS = 20_000
#: Labels are broadcast up to this many rows (9 bytes each), beyond it the join shuffles.
BROADCAST_LABELS = 4_000_000
THRESHOLD = 0.3
FEATURES = 3
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[0x80:] = False
_START, _END = 2, 3


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def _flat(words: list[bytes] | None, data: np.ndarray | None = None, s: np.ndarray | None = None, e: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All words with their marks in one array, and where each begins (one more at the end)."""
    if words is not None:
        data = np.frombuffer(b"".join(words), np.uint8)
        e = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        s = np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e
    size = e - s + 2
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.empty(begin[-1], np.uint8)
    out[begin[:-1]], out[begin[1:] - 1] = _START, _END
    inner = size - 2
    at = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat(begin[:-1] + 1, inner) + at] = data[np.repeat(s, inner) + at]
    return out, begin


def _grams(flat: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place but start marks: its index, and for n = 1..order the hash of the n characters that end there (valid
    where the word has that many so far)."""
    rank = np.arange(len(flat)) - np.repeat(begin[:-1], np.diff(begin))
    h = [X.mix(flat.astype(np.uint64) + _U(1))]
    for n in range(1, order):
        last = h[-1]
        before = np.zeros_like(last)
        before[1:] = last[:-1]
        # characters n before, with this one at the end
        h.append(X.mix(before * _U(0x9E3779B97F4A7C15) + flat.astype(np.uint64) + _U(n << 16)))
    return rank, h


def gram_counts(words: list[bytes], counts: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: distinct (hash of n-gram, hash of its history, hash of its suffix) with counts of both classes."""
    flat, begin = _flat(words)
    rank, h = _grams(flat, begin, order)
    per = np.repeat(counts, np.diff(begin), axis=0)
    out = []
    for n in range(1, order + 1):
        # the longest history: order characters, or all of the word so far
        at = np.flatnonzero((rank >= 1) & (rank >= n - 1))
        key = h[n - 1][at]
        history = h[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        suffix = h[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
        u, first, inv = np.unique(key, return_index=True, return_inverse=True)
        total = np.stack([np.bincount(inv, per[at, c], len(u)) for c in (0, 1)], 1).astype(np.int64)
        out.append((np.stack([u, history[first], suffix[first]], 1), total))
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in ascending keys; len(keys) where it is not among them."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


class Model:
    """Tables by n-gram and by history, in order of their hashes, with one more entry for the unseen. own_p, own_l: class
    parts of n-grams at the longest history; p, l: the backoff."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT):
        self.order = order
        self.grams, self.histories, self.own_p, self.own_l, self.p, self.l = [], [], [], [], [], []
        for n in range(1, order + 1):
            keys, count = grams[n - 1]
            by = np.argsort(keys[:, 0])
            keys, count = keys[by], count[by]
            known, hist = np.unique(keys[:, 1], return_inverse=True)
            self.grams.append(keys[:, 0].copy())
            self.histories.append(known)
            p, back = np.zeros((2, len(keys) + 1), np.float32), np.ones((2, len(known) + 1), np.float32)
            for c in (0, 1):
                n_c = count[:, c]
                total, kinds = np.bincount(hist, n_c, len(known)), np.bincount(hist, n_c > 0, len(known))
                p[c, :-1] = np.maximum(n_c - discount, 0) / np.maximum(total[hist], 1)
                back[c, :-1] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
            self.own_p.append(p)
            self.own_l.append(back)
            # continuation counts: distinct longer n-grams that end in this one; at the top order plain counts are not used
            if n < order:
                ends = _find(keys[:, 0], grams[n][0][:, 2])
                m = np.maximum(np.bincount(ends, minlength=len(keys) + 1)[:-1], 1)
                total, kinds = np.bincount(hist, m, len(known)), np.bincount(hist, minlength=len(known))
                self.p.append(np.append(np.maximum(m - discount, 0) / np.maximum(total[hist], 1), 0).astype(np.float32))
                self.l.append(np.append(discount * kinds / np.maximum(total, 1), 1).astype(np.float32))

    def evidence(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each word: log-likelihood as toxic less that as ordinary."""
        rank, h = _grams(flat, begin, self.order)
        llr = np.zeros(len(flat))
        shared = np.full(len(flat), 1 / 256)
        for n in range(1, self.order + 1):
            ok = np.flatnonzero((rank >= 1) & (rank >= n - 1))
            s = _find(self.grams[n - 1], h[n - 1][ok])
            t = _find(self.histories[n - 1], h[n - 2][ok - 1] if n > 1 else np.zeros(len(ok), np.uint64))
            low = shared[ok]
            # history ends here: the word is just so long, or the order is reached
            own = rank[ok] == n - 1 if n < self.order else np.ones(len(ok), bool)
            if own.any():
                a, b = (self.own_p[n - 1][c][s[own]] + self.own_l[n - 1][c][t[own]] * low[own] for c in (1, 0))
                llr[ok[own]] = np.log(np.maximum(a, 1e-12)) - np.log(np.maximum(b, 1e-12))
            if n < self.order:
                shared[ok] = self.p[n - 1][s] + self.l[n - 1][t] * low
        return _add(llr, begin)


def _add(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values)])
    return c[begin[1:]] - c[begin[:-1]]


def features(model: Model, column: pa.Array, window: int = WINDOW) -> np.ndarray:
    """Columns: mean evidence a word over the whole text, over the best window, and the logarithm of the text's length in
    words, as a longer text has more windows to choose from. Each distinct word is scored once a block."""
    data, offs = X.buffers(column)
    out = np.zeros((len(offs) - 1, FEATURES))
    for i, j in X.blocks(offs):
        part, o = fold(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        s, e, first = X.word_bounds(part, o, _GAP)
        if not len(s):
            continue
        _, at, inv = np.unique(X.word_hashes(part, s, e), return_index=True, return_inverse=True)
        w = model.evidence(*_flat(None, part, s[at], e[at]))[inv]
        c = np.concatenate([[0.0], np.cumsum(w)])
        n = np.diff(first)
        full = np.flatnonzero(n)
        out[i + full, 0] = (c[first[1:]] - c[first[:-1]])[full] / n[full]
        # best window: windows may not leave the text, shorter texts count as one window of full length
        starts = np.arange(len(w))
        end = np.minimum(starts + window, np.repeat(first[1:], n))
        out[i + full, 2] = np.log1p(n[full])
        out[i + full, 1] = np.maximum.reduceat((c[end] - c[starts]) / window, first[:-1][full])
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; x gets a column of ones and is scaled."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold_of(id: Column) -> Column:
    """crc32 of the id as text, modulo 4: the one definition of who is held out."""
    return F.crc32(id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = ORDER, calibration_rows: int = CALIBRATION_ROWS):
    """(model, curve) or (None, share of toxic labels)."""
    spark = docs.sparkSession
    ship(spark)
    remainder = fold_of(F.col("_id"))
    y = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & (remainder != 2))
    n, toxic = y.agg(F.count("*"), F.sum(F.when(F.col("_y") > 0, 1).otherwise(0))).first()
    if not n or not toxic or toxic == n:
        return None, ((toxic or 0) + 1) / (n + 2)
    if n <= BROADCAST_LABELS:
        y = F.broadcast(y)
    d = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t")).where(remainder != 2)
    rows = d.join(y, "_id").withColumn("_f", remainder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = X.buffers(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False) > 0
            for i, j in X.blocks(offs, 4 * X.BLOCK):
                part, o = fold(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
                s, e, first = X.word_bounds(part, o, _GAP)
                if not len(s):
                    continue
                _, at, inv = np.unique(X.word_hashes(part, s, e), return_index=True, return_inverse=True)
                bad = np.repeat(y[i:j], np.diff(first))
                n1 = np.bincount(inv, bad, len(at)).astype(np.int64)
                n0 = np.bincount(inv, minlength=len(at)) - n1
                raw = part.tobytes()
                words = [raw[a:z] for a, z in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], names=["w", "n0", "n1"])

    words = rows.where("_f < 2").select("_t", "_y").mapInArrow(count, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], 1)
                for n, (keys, total) in enumerate(gram_counts(b.column(0).to_pylist(), c, order), 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n), pa.int32()), *(pa.array(keys[:, k].astype(np.int64)) for k in range(3)), *(pa.array(total[:, k]) for k in (0, 1))], names=["n", "k", "h", "s", "n0", "n1"])

    # one row for each distinct n-gram
    grams = words.mapInArrow(spread, "n int, k long, h long, s long, n0 long, n1 long").groupBy("n", "k", "h", "s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = materialise(grams, "grams").toArrow()
    col = {c: got.column(c).to_numpy() for c in got.column_names}
    made = []
    for n in range(1, order + 1):
        at = col["n"] == n
        made.append((np.stack([col[c][at] for c in ("k", "h", "s")], 1).astype(np.uint64), np.stack([col[c][at] for c in ("n0", "n1")], 1)))
    model = Model(made, order)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(shared.value, b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(f[:, k]) for k in range(FEATURES))], names=["y", *(f"f{k}" for k in range(FEATURES))])

    some = rows.where("_f = 3").select("_id", "_t", "_y").orderBy(F.xxhash64("_id")).limit(calibration_rows) if n > 4 * calibration_rows else rows.where("_f = 3")
    fit = some.select("_t", "_y").mapInArrow(measure, "y int, " + ", ".join(f"f{k} double" for k in range(FEATURES))).toArrow()
    y, f = fit.column("y").to_numpy() > 0, np.stack([fit.column(f"f{k}").to_numpy() for k in range(FEATURES)], 1)
    if not len(y) or y.all() or not y.any():
        y, f = np.array([False, True]), np.array([[-1.0, -1.0, 0.0], [1.0, 1.0, 0.0]])
    return shared, fit_curve(f, y.astype(float))


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """(id, held_out, score, predicted, evidence, peak) for each row of docs. Null ids are not held out."""
    shared, curve = train(docs, labels, id, text, label, **kw)
    kind = docs.schema[id].dataType.simpleString()
    held = F.coalesce(fold_of(F.col(id)) == 2, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared is None:
                f, p = np.zeros((b.num_rows, FEATURES)), np.full(b.num_rows, curve)
            else:
                f = features(shared.value, b.column(1))
                p = 1 / (1 + np.exp(-np.clip(curve[0] + f @ curve[1:], -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(f[:, 0]), pa.array(f[:, 1])], names=[id, "held_out", "score", "predicted", "evidence", "peak"])

    return docs.select(F.col(id), F.col(text).cast("string").alias("t"), held.alias("h")).mapInArrow(run, f"`{id}` {kind}, held_out boolean, score double, predicted int, evidence double, peak double")
