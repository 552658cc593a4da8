"""Exact substring deduplication over words, with fixed-block anchors.

A window is `window` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts earlier (smaller id, or the same document, earlier start). Every occurrence of a window holds a whole aligned
block of `window // 2` words, so:

1. Index and probe: a document's aligned blocks are the reference index, and all its rolling block-sized windows are
   probes. Groups of documents send both as truncated hashes to buckets, each hash once a group with marks for "is
   a reference block" and "occurs again in this group". A bucket answers with the hashes that have a reference block
   and occur at two places or more: the hits.
2. Extend: back at the documents, each hit is extended to all windows that hold it. Their full hashes (96 bits) go to
   buckets, from each group its first occurrence only, and all but the earliest occurrence are marked. Overlapping
   marked windows are the maximal repeats, and their words go.

Counts are pre-aggregated in each group before both shuffles, so a passage in a third of all documents is one entry a
group. The answer does not depend on truncation: step 1 may let more candidates through, never fewer.

Null text: no words. Words are compared as they are. Rows with the same id count as one document after another, in order
of a hash of their texts (so a repeated id is no hot group). Removed words leave the others joined by one space. Rows with
a null id come first. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import text as X
from fathom.llm.exchange import bucket_of, grouped, in_order, split_by

WINDOW = 20
_U = np.uint64
#: Probes are 5 bytes: 38 bits of the hash, then the marks.
_REF, _AGAIN, _KEEP = 1, 2, 5
_ASK = np.dtype([("k", "<u8"), ("k2", "<u4"), ("at", "<u4"), ("doc", "<i8")])


def _pack(v: np.ndarray) -> bytes:
    return v.view(np.uint8).reshape(-1, 8)[:, :_KEEP].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _KEEP, 8), np.uint8)
    out[:, :_KEEP] = np.frombuffer(raw, np.uint8).reshape(-1, _KEEP)
    return out.view(np.uint64).ravel()


class _Words:
    """Word hashes of a group's documents, made block by block to bound memory."""

    def __init__(self, table: pa.Table):
        self.data, self.offs = X.buffers(table.column("text"))
        hashes, firsts = [], [0]
        for i, j in X.blocks(self.offs):
            part, offs = self.data[self.offs[i] : self.offs[j]], self.offs[i : j + 1] - self.offs[i]
            s, e, first = X.word_bounds(part, offs)
            hashes.append(X.word_hashes(part, s, e))
            firsts.extend((first[1:] + firsts[-1]).tolist())
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.array(firsts, np.int64)

    def grams(self, n: int, base=X._GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of n words that lie in one document, and their hashes."""
        at = X.gram_starts(self.first, n)
        return at, X.gram_hashes(self.h, n, base)[at] if len(at) else np.zeros(0, np.uint64)


def _code(h: np.ndarray) -> np.ndarray:
    """The 38 bits that a probe keeps, above two bits for marks."""
    return (h & _U((1 << 38) - 1)) << _U(2)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text, n_words, n_removed) for each row; text: the kept words joined by one space."""
    if window < 2:
        raise ValueError("a window has two words at least")
    groups = grouped(docs, id, text)
    block = window // 2
    n1, n2 = groups.buckets(1 << 20, 6), groups.buckets(1 << 20, 24)

    def probe(table: pa.Table) -> pa.Table:
        w = _Words(in_order(table))
        at, h = w.grams(block)
        doc = np.searchsorted(w.first, at, "right") - 1
        ref = ((at - w.first[doc]) % block == 0).astype(np.uint64) * _U(_REF)
        order = np.argsort(h, kind="stable")
        h, ref = h[order], ref[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        if len(first):
            again = (np.diff(np.append(first, len(h))) > 1).astype(np.uint64) * _U(_AGAIN)
            h, marks = h[first], np.bitwise_or.reduceat(ref, first) | again
        else:
            marks = ref
        parts = split_by(bucket_of(h, n1), _code(h) | marks)
        g = table.column("g")[0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()), "probes": pa.array([_pack(p[0]) for _, p in parts], pa.binary())})

    def hit(table: pa.Table) -> pa.Table:
        blobs = table.column("probes").to_pylist()
        sender = np.repeat(np.array(table.column("g").to_pylist(), np.int64), [len(b) // _KEEP for b in blobs])
        v = _unpack(b"".join(blobs))
        order = np.argsort(v, kind="stable")
        v, sender = v[order], sender[order]
        k = v >> _U(2)
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        marks = np.bitwise_or.reduceat(v & _U(3), first)
        hot = ((size > 1) | ((marks & _U(_AGAIN)) > 0)) & ((marks & _U(_REF)) > 0)
        rows = np.repeat(hot, size)
        parts = split_by(sender[rows], k[rows] << _U(2))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"g": pa.array([x for x, _ in parts], pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int64()), "hits": pa.array([_pack(p[0]) for _, p in parts], pa.binary())})

    def candidates(w: _Words, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold a hit."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if not right.num_rows:
            return none
        at, h = w.grams(block)
        bucket = bucket_of(h, n1)
        # a hit counts in its own bucket only
        hits = np.concatenate([_unpack(x) >> _U(2) | _U(b) << _U(38) for b, x in zip(right.column("bucket").to_pylist(), right.column("hits").to_pylist(), strict=True)])
        found = at[np.isin(_code(h) >> _U(2) | bucket << _U(38), hits)]
        if not len(found):
            return none
        is_hit = np.zeros(len(w.h) + 1, np.int64)
        is_hit[found + 1] = 1
        c = np.cumsum(is_hit)
        starts, k = w.grams(window)
        if not len(starts):
            return none
        own = c[starts + window - block + 1] - c[starts] > 0
        return starts[own], k[own], w.grams(window, X._GRAM2)[1][own]

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "asked": pa.array([], pa.binary()), "again": pa.array([], pa.binary())})
        if not left.num_rows:
            return empty
        left = in_order(left)
        w = _Words(left)
        starts, k, k2 = candidates(w, right)
        if not len(starts):
            return empty
        k2 = (k2 >> _U(32)).astype(np.uint32)
        order = np.lexsort((starts, k2, k))
        starts, k, k2 = starts[order], k[order], k2[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        again = starts[~new].astype(np.uint32)
        ids = np.array([-(1 << 63) if x is None else x for x in left.column("id").to_pylist()], np.int64)
        asked = np.zeros(int(new.sum()), _ASK)
        asked["k"], asked["k2"], asked["at"] = k[new], k2[new], starts[new]
        asked["doc"] = ids[np.searchsorted(w.first, starts[new], "right") - 1]
        parts = split_by(bucket_of(asked["k"], n2), asked)
        g = left.column("g")[0].as_py()
        # occurrences after this group's first need no bucket; they come along with one of its questions, spread by group
        return pa.table({"bucket": pa.array([x for x, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()), "asked": pa.array([p[0].tobytes() for _, p in parts], pa.binary()), "again": pa.array([again.tobytes() if n == g % len(parts) else b"" for n in range(len(parts))], pa.binary())})

    def earliest(table: pa.Table) -> pa.Table:
        blobs = table.column("asked").to_pylist()
        groups_of = table.column("g").to_pylist()
        a = np.frombuffer(b"".join(blobs), _ASK)
        sender = np.repeat(np.array(groups_of, np.int64), [len(b) // _ASK.itemsize for b in blobs])
        # rows that repeat an id stand in order of their groups
        order = np.lexsort((sender, a["doc"], a["k2"], a["k"]))
        a, sender = a[order], sender[order]
        later = np.zeros(len(a), bool)
        later[1:] = (a["k"][1:] == a["k"][:-1]) & (a["k2"][1:] == a["k2"][:-1])
        found: dict[int, list[bytes]] = {k: [p[0].tobytes()] for k, p in split_by(sender[later], a["at"][later])}
        for g, x in zip(groups_of, table.column("again").to_pylist(), strict=True):
            if x:
                found.setdefault(g, []).append(x)
        return pa.table({"g": pa.array(list(found), pa.int64()), "starts": pa.array([b"".join(x) for x in found.values()], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = in_order(left)
        marked = np.frombuffer(b"".join(right.column("starts").to_pylist()), np.uint32).astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        texts = left.column("text").cast(pa.large_binary()).to_pylist()
        words = [t.split() if t else [] for t in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64) if words else np.zeros(1, np.int64)
        gone = X.covered(np.sort(marked), window, int(first[-1]))
        removed = X.per_text(gone, first)
        keep = (~gone).tolist()
        kept = [b" ".join(x) if not r else b" ".join([y for y, k in zip(x, keep[i : i + len(x)], strict=True) if k]) for x, r, i in zip(words, removed.tolist(), first[:-1].tolist(), strict=True)]
        return pa.table({"id": left.column("id"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    d = groups.docs.groupBy("g")
    hits = d.applyInArrow(probe, "bucket long, g long, probes binary").groupBy("bucket").applyInArrow(hit, "g long, bucket long, hits binary")
    asked = d.cogroup(hits.groupBy("g")).applyInArrow(extend, "bucket long, g long, asked binary, again binary")
    marked = asked.groupBy("bucket").applyInArrow(earliest, "g long, starts binary")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("text string, n_words long, n_removed long")])
    out = d.cogroup(marked.groupBy("g")).applyInArrow(cut, schema)
    return out.select(F.col("id").alias(id), F.col("text").alias(text), "n_words", "n_removed")
