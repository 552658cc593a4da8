"""Incremental, reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line with white space stripped at both ends and A-Z lower-cased; keys are held as 96-bit hashes.
A shard holds, for its part of the keys, an exact table (key, number of documents, largest id) and a cuckoo filter of the
keys that are in at least min_docs documents. Inserting documents raises counts, and a key that reaches min_docs enters
the filter; deleting documents lowers them, and a key that falls below leaves it. Lines are first looked up in the filter;
only its hits are looked up in the table, which decides.

Bulk path (drop_lines): groups of documents send each shard every key once with a count and largest id, the shard takes
them in, the same keys probe it, and it answers with those to drop; groups cut their lines. LineIndex is the stored,
incremental form, with the same Shard.

Null or empty text: one empty line. Lines of fewer than min_points code points are never dropped. A document is a row;
rows that repeat an id count as one document when they hold the same key, and meet in one group for that. Rows with a null
id lose no line and count for none. Ids must be integers. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.exchange import bucket_of, grouped, split_by
from fathom.llm.text import mix
from fathom.session import new_path, ship

STRIP = b" \t\n\x0b\x0c\r"
MIN_POINTS, MIN_DOCS = 20, 3
_U = np.uint64


class CuckooFilter:
    """Cuckoo filter of 64-bit hashes: 4 slots of 16 bits a bucket, two buckets for a hash; adding and removing in bulk."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None, stash: np.ndarray | None = None):
        if table is None:
            n = 1
            while n * self.SLOTS * 0.85 < capacity + 1:
                n *= 2
            table = np.zeros((n, self.SLOTS), np.uint16)
        self.table = table
        #: Hashes that found no slot: rare, and looked up one by one, so that no key is ever lost.
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = _U(len(self.table) - 1)
        mark = (mix(h) >> _U(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        i = (h & mask).astype(np.int64)
        return mark, i, self._other(mark, i)

    def _other(self, mark: np.ndarray, i: np.ndarray) -> np.ndarray:
        mask = _U(len(self.table) - 1)
        return (i.astype(np.uint64) ^ ((mark.astype(np.uint64) * _U(0x5BD1E995)) & mask)).astype(np.int64)

    def room(self, n: int) -> bool:
        """Whether n more hashes can be added without crowding."""
        return int((self.table != 0).sum()) + len(self.stash) + n <= 0.85 * self.table.size

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, i, j = self._places(h)
        hit = (self.table[i] == mark[:, None]).any(1) | (self.table[j] == mark[:, None]).any(1)
        return hit | np.isin(h, self.stash) if len(self.stash) else hit

    def add(self, h: np.ndarray) -> None:
        rng = np.random.Generator(np.random.PCG64(5))
        mark, i, j = self._places(h)
        for k in range(len(h)):
            m, a = mark[k], i[k]
            for at in (a, j[k]):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                trail = []
                for _ in range(self.KICKS):
                    s = int(rng.integers(self.SLOTS))
                    trail.append((a, s))
                    m, self.table[a, s] = self.table[a, s], m
                    a = int(self._other(np.array([m], np.uint16), np.array([a]))[0])
                    free = np.flatnonzero(self.table[a] == 0)
                    if len(free):
                        self.table[a, free[0]] = m
                        break
                else:
                    for a, s in reversed(trail):
                        m, self.table[a, s] = self.table[a, s], m
                    self.stash = np.append(self.stash, h[k])

    def remove(self, h: np.ndarray) -> None:
        """h must have been added before."""
        mark, i, j = self._places(h)
        for k in range(len(h)):
            for at in (i[k], j[k]):
                own = np.flatnonzero(self.table[at] == mark[k])
                if len(own):
                    self.table[at, own[0]] = 0
                    break
            else:
                self.stash = np.delete(self.stash, np.flatnonzero(self.stash == h[k])[:1])

    def dump(self) -> bytes:
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        end = 8 + n * cls.SLOTS * 2
        return cls(0, np.frombuffer(raw[8:end], np.uint16).reshape(n, cls.SLOTS).copy(), np.frombuffer(raw[end:], np.uint64).copy())


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _keyed(text: bytes | None, min_points: int) -> list[bytes | None]:
    """16 bytes for each line that could be dropped, None for the others."""
    out = []
    for line in split_lines(text):
        key = line_key(line)
        out.append(xxhash.xxh3_128_digest(key) if len(key) >= min_points and _points(key) >= min_points else None)
    return out


_ASK = np.dtype([("k", "<u8"), ("k2", "<u4"), ("n", "<u4"), ("top", "<i8")])


def _table(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), _ASK)


class Shard:
    """The exact table of a part of the keys (in order: key, number of documents, largest id) and the cuckoo filter of those
    that are in at least min_docs documents."""

    def __init__(self, min_docs: int = MIN_DOCS, table: np.ndarray | None = None, filter: CuckooFilter | None = None):
        self.min_docs = min_docs
        self.table = np.zeros(0, _ASK) if table is None else table
        self.filter = CuckooFilter(64) if filter is None else filter

    def update(self, changed: np.ndarray) -> None:
        """Takes new counts and largest ids of keys, each key once; a count of 0 takes the key out. Keys that reach min_docs
        enter the filter, keys that fall below leave it."""
        both = np.concatenate([self.table, changed])
        new = np.repeat([False, True], [len(self.table), len(changed)])
        order = np.lexsort((new, both["k2"], both["k"]))
        t, new = both[order], new[order]
        replaced = np.zeros(len(t), bool)
        replaced[:-1] = (t["k"][1:] == t["k"][:-1]) & (t["k2"][1:] == t["k2"][:-1])
        was, now = t["n"] >= self.min_docs, (t["n"] >= self.min_docs) & new
        before = np.zeros(len(t), bool)
        before[1:] = (replaced & was)[:-1]
        leaves, enters = t["k"][new & before & ~now], t["k"][now & ~before]
        self.table = t[~replaced & (t["n"] > 0)]
        self.filter.remove(leaves)
        if not self.filter.room(len(enters)):
            active = self.table["k"][self.table["n"] >= self.min_docs]
            self.filter = CuckooFilter(2 * len(active))
            self.filter.add(active)
        else:
            self.filter.add(enters)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys (fields k and k2) are in min_docs documents or more, and the largest id of each: the filter is asked
        first, and only its hits are looked up in the table."""
        hit = np.flatnonzero(self.filter.contains(np.ascontiguousarray(keys["k"]))) if len(keys) else np.zeros(0, np.int64)
        x = keys[hit]
        at, end = (np.searchsorted(self.table["k"], x["k"], side) for side in ("left", "right"))
        ok, top = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        # keys with equal first halves stand side by side, rarely more than one
        for step in range(int((end - at).max()) if len(x) else 0):
            here = np.flatnonzero(at + step < end)
            row = self.table[at[here] + step]
            same = (row["k2"] == x["k2"][here]) & (row["n"] >= self.min_docs)
            ok[here[same]], top[here[same]] = True, row["top"][same]
        return hit[ok], top[ok]

    def dump(self) -> bytes:
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + self.filter.dump()

    @classmethod
    def load(cls, raw: bytes, min_docs: int) -> Shard:
        end = 8 + int(np.frombuffer(raw, np.int64, 1)[0]) * _ASK.itemsize
        return cls(min_docs, np.frombuffer(raw[8:end], _ASK), CuckooFilter.load(raw[end:]))


def totals(asked: np.ndarray) -> np.ndarray:
    """One row a key: counts added, the largest id."""
    a = asked[np.lexsort((asked["k2"], asked["k"]))]
    if not len(a):
        return a
    new = np.ones(len(a), bool)
    new[1:] = (a["k"][1:] != a["k"][:-1]) | (a["k2"][1:] != a["k2"][:-1])
    at = np.flatnonzero(new)
    out = a[at].copy()
    out["n"] = np.minimum(np.add.reduceat(a["n"].astype(np.int64), at), 0xFFFFFFFF)
    out["top"] = np.maximum.reduceat(a["top"], at)
    return out


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, rest: bool = False) -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row: text without the lines whose key is in min_docs documents or more,
    unless this is the document with the largest id that holds the key. rest: all other columns of docs too, as a struct."""
    groups = grouped(docs, id, text, rest=rest, whole_ids=True)
    rest = "rest" in groups.docs.columns
    shards = groups.buckets(1 << 18, 80)

    def ask(table: pa.Table) -> pa.Table:
        seen: dict[bytes, list] = {}
        for i, t in zip(table.column("id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            if i is None:
                continue
            for key in set(_keyed(t, min_points)) - {None}:
                seen.setdefault(key, []).append(i)
        raw = np.frombuffer(b"".join(seen), np.dtype([("k", "<u8"), ("k2", "<u4"), ("rest", "<u4")]))
        asked = np.zeros(len(raw), _ASK)
        asked["k"], asked["k2"] = raw["k"], raw["k2"]
        asked["n"] = [len(set(x)) for x in seen.values()]
        asked["top"] = [max(x) for x in seen.values()]
        parts = split_by(bucket_of(asked["k"], shards), asked)
        g = table.column("g")[0].as_py()
        return pa.table({"shard": pa.array([k for k, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()), "asked": pa.array([p[0].tobytes() for _, p in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        blobs = table.column("asked").to_pylist()
        asked = _table(blobs)
        sender = np.repeat(np.array(table.column("g").to_pylist(), np.int64), [len(b) // _ASK.itemsize for b in blobs])
        shard = Shard(min_docs)
        shard.update(totals(asked))
        hit, top = shard.probe(asked)
        out = asked[hit]
        out["top"] = top
        parts = split_by(sender[hit], out)
        return pa.table({"g": pa.array([k for k, _ in parts], pa.int64()), "found": pa.array([p[0].tobytes() for _, p in parts], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _table(right.column("found").to_pylist())
        top = {k: t for k, t in zip(zip(found["k"].tolist(), found["k2"].tolist(), strict=True), found["top"].tolist(), strict=True)}
        kept, lines, dropped = [], [], []
        for i, t in zip(left.column("id").to_pylist(), left.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            own, keys = split_lines(t), _keyed(t, min_points) if top and i is not None else ()
            bad = {n for n, k in enumerate(keys) if k is not None and (last := top.get((int.from_bytes(k[:8], "little"), int.from_bytes(k[8:12], "little")))) is not None and last != i}
            lines.append(len(own))
            dropped.append(len(bad))
            kept.append(b"\n".join(x for n, x in enumerate(own) if n not in bad) if bad else t or b"")
        out = {"id": left.column("id"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        return pa.table(out | ({"rest": left.column("rest")} if rest else {}))

    asked = groups.docs.groupBy("g").applyInArrow(ask, "shard long, g long, asked binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "g long, found binary")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("text string, n_lines long, n_dropped long"), *([groups.docs.schema["rest"]] if rest else [])])
    out = groups.docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(cut, schema)
    return out.select(F.col("id").alias(id), F.col("text").alias(text), "n_lines", "n_dropped", *(["rest"] if rest else []))


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """df with kept_sha256 in place of the text."""
    return df.withColumn("kept_sha256", F.sha2(F.col(text).cast("binary"), 256)).drop(text)


_POSTING = "shard int, key binary, doc long"


class LineIndex:
    """A stored index that takes insertions and deletions. Each version holds what it changed only: delta(shard, key, doc,
    sign), whose sums are the postings, and the changed shards (shard, state), tables and filters as in Shard. insert and
    delete write a new version and leave the old ones as they are; a version has one successor.

    shards: how many; each is one task's, at 24 bytes a distinct key, so set it for the corpus that is to come (about one
    to 20 MB of text). create() takes it from the first documents, if given."""

    def __init__(self, spark, path: str, version: int = 0, shards: int = 16, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.version, self.shards, self.min_points, self.min_docs = spark, path.rstrip("/"), version, shards, min_points, min_docs

    @classmethod
    def create(cls, spark, path: str | None = None, docs: DataFrame | None = None, text: str = "text", **kw) -> LineIndex:
        if docs is not None and "shards" not in kw:
            kw["shards"] = 16 + (docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) // (5 << 20)
        self = cls(spark, path or new_path(spark, "line-index"), **kw)
        spark.createDataFrame([], f"{_POSTING}, sign int").write.parquet(f"{self.path}/delta/v=0")
        spark.createDataFrame([], "shard int, state binary").write.parquet(f"{self.path}/shards/v=0")
        return self

    def postings(self) -> DataFrame:
        """(shard, key, doc): which documents hold a key."""
        delta = self.spark.read.schema(f"{_POSTING}, sign int, v int").parquet(f"{self.path}/delta").where(F.col("v") <= self.version)
        return delta.groupBy("shard", "key", "doc").agg(F.sum("sign").alias("sign")).where("sign > 0").select("shard", "key", "doc")

    def states(self) -> DataFrame:
        """(shard, state): the newest of each shard."""
        all_ = self.spark.read.schema("shard int, state binary, v int").parquet(f"{self.path}/shards").where(F.col("v") <= self.version)
        newest = all_.groupBy("shard").agg(F.max("v").alias("v"))
        return all_.join(newest, ["shard", "v"]).select("shard", "state")

    def _lines(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        ship(self.spark)
        shards, min_points = self.shards, self.min_points

        def run(batches):
            for b in batches:
                keys, ids = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    own = set(_keyed(t, min_points)) - {None} if i is not None else set()
                    keys.extend(own)
                    ids.extend([i] * len(own))
                shard = [int.from_bytes(k[4:8], "little") * shards >> 32 for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["shard", "key", "doc"])

        return docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _POSTING).distinct()

    def _changed(self, ids: DataFrame, lines: DataFrame | None) -> LineIndex:
        """The next version, in which documents ids hold lines and nothing else."""
        new = LineIndex(self.spark, self.path, self.version + 1, self.shards, self.min_points, self.min_docs)
        old = self.postings()
        gone = old.join(ids, "doc", "left_semi").select("shard", "key", "doc", F.lit(-1).alias("sign"))
        change = gone if lines is None else gone.union(lines.select("shard", "key", "doc", F.lit(1).alias("sign")))
        change.groupBy("shard", "key", "doc").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").write.parquet(f"{new.path}/delta/v={new.version}")
        touched = self.spark.read.schema(f"{_POSTING}, sign int").parquet(f"{new.path}/delta/v={new.version}").select("shard", "key").distinct()
        counts = touched.join(new.postings(), ["shard", "key"], "left").groupBy("shard", "key").agg(F.count("doc").alias("n"), F.coalesce(F.max("doc"), F.lit(0).cast("long")).alias("top"))
        min_docs = self.min_docs

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.table({"shard": pa.array([], pa.int32()), "state": pa.array([], pa.binary())})
            shard = Shard.load(left.column("state")[0].as_py(), min_docs) if left.num_rows else Shard(min_docs)
            shard.update(_asked(right))
            return pa.table({"shard": right.column("shard").slice(0, 1), "state": pa.array([shard.dump()], pa.binary())})

        self.states().groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(update, "shard int, state binary").write.parquet(f"{new.path}/shards/v={new.version}")
        return new

    def insert(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> LineIndex:
        """Adds documents. One that is in the index already is replaced; rows that repeat an id are one document."""
        ids = docs.select(F.col(id).cast("long").alias("doc")).where("doc is not null").distinct()
        return self._changed(ids, self._lines(docs, id, text))

    def delete(self, ids: DataFrame, id: str = "doc_id") -> LineIndex:
        """Takes documents out; ids that are not in the index change nothing."""
        return self._changed(ids.select(F.col(id).cast("long").alias("doc")).where("doc is not null").distinct(), None)

    def drops(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, key) of the lines to drop: filter first, hits confirmed by the exact table."""
        ship(self.spark)
        min_docs = self.min_docs

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.slice(0, 0).select(["doc", "key"])
            hit, top = Shard.load(right.column("state")[0].as_py(), min_docs).probe(_keys(left))
            doc = left.column("doc").to_numpy()[hit]
            return left.select(["doc", "key"]).take(pa.array(hit[doc != top]))

        return self._lines(docs, id, text).groupBy("shard").cogroup(self.states().groupBy("shard")).applyInArrow(probe, "doc long, key binary")


def _keys(table: pa.Table) -> np.ndarray:
    raw = np.frombuffer(b"".join(table.column("key").to_pylist()), np.dtype([("k", "<u8"), ("k2", "<u4"), ("rest", "<u4")]))
    out = np.zeros(len(raw), _ASK)
    out["k"], out["k2"] = raw["k"], raw["k2"]
    return out


def _asked(table: pa.Table) -> np.ndarray:
    out = _keys(table)
    out["n"], out["top"] = table.column("n").to_numpy(), table.column("top").to_numpy()
    return out


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs with the dropped lines cut from the text, all other columns as they are."""
    out = drop_lines(docs, id, text, rest=True, **kw)
    return out.select(*(F.col(c) if c in (id, text) else F.col("rest")[c].alias(c) for c in docs.columns))


__all__ = ["CuckooFilter", "LineIndex", "Shard", "dedup_lines", "digest", "drop_lines"]
