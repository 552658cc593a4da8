"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at RADIUS = 3 or fewer differing bits. Every fingerprint emits the variants within half the
radius: itself and all 1-bit variants; fingerprints of odd weight also emit 2-bit variants whose two bits lie in the
same 32-bit half. That finds every link: at distance 1 or 2 the 1-bit balls meet (or hold the other's centre); at
distance 3 one end has odd weight, and two of the three bits lie in one half, so its 2-bit ball meets the other's 1-bit
ball. Two members of a variant at most one of which came by a 2-bit flip are within 3 bits, so a variant's members link
in a star to one 1-bit member instead of in all pairs.

Variants are shuffled implicitly: the bucket of a variant is a linear (XOR) hash of its bits, a fingerprint is sent
once to each bucket that one of its variants falls in, and the bucket makes just those variants again. The number of
buckets grows with the number of distinct fingerprints, so a bucket's memory is bounded.

Null and wordless texts have fingerprint zero and link like any other. Rows with the same id each get a fingerprint and
the same component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import text as X
from fathom.llm.components import connected_components, local_forest
from fathom.session import materialise, ship

RADIUS = 3
SEED = 42
#: Variants that one bucket makes at about, of all fingerprints that reach it.
BUCKET_VARIANTS = 1 << 21
_U = np.uint64
_LANE = _U(0x0101010101010101)
_ONE = [1 << i for i in range(64)]
_TWO = [_ONE[i] | _ONE[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
NEAR, FAR = np.array([0, *_ONE], np.uint64), np.array(_TWO, np.uint64)
_COLUMNS = [int(x) for x in np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 62, 64, dtype=np.int64)]


def _bits_set(h: np.ndarray) -> np.ndarray:
    """For each bit 0..63, in how many of h it is set."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 64):
        part = h[i : i + 255 * 64]
        cut = np.arange(0, len(part), 255)
        for k in range(8):
            lanes = np.add.reduceat((part >> _U(k)) & _LANE, cut).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
            out[k::8] += lanes
    return out


def fingerprint(text: bytes, n: int = 3, seed: int = SEED) -> int:
    """SimHash of the n-word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(norm, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - n] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(norm[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)
    return folded(h)


def folded(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: the bits that over half of them have."""
    bits = 2 * _bits_set(h) > len(h)
    return int(np.packbits(bits[::-1]).view(">u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id, "fp"])

    return docs.select(F.col(id), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, fp long")


def _linear(x: np.ndarray, bits: int) -> np.ndarray:
    """A linear hash of 64 bits to a few: XOR of the columns of the set bits."""
    x = np.asarray(x, np.uint64)
    out = np.zeros(len(x), np.uint64)
    for i, c in enumerate(_COLUMNS):
        out ^= ((x >> _U(i)) & _U(1)) * _U(c & ((1 << bits) - 1))
    return out.astype(np.int64)


def _by_syndrome(masks: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    s = _linear(masks, bits)
    order = np.argsort(s, kind="stable")
    keys, at = np.unique(s[order], return_index=True)
    return dict(zip(keys.tolist(), np.split(masks[order], at[1:]), strict=True))


def _odd(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(bool)


def bucket_links(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a forest of them) that the variants of fps in one bucket show."""
    return local_forest(*bucket_pairs(fps, bucket, bits))


def bucket_pairs(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within RADIUS, stars of the variants of fps in one bucket."""
    near, far = _by_syndrome(NEAR, bits), _by_syndrome(FAR, bits)
    fps = np.unique(fps)
    s = _linear(fps, bits) ^ bucket
    variants, source, is_far = [], [], []
    order = np.argsort(s, kind="stable")
    keys, at = np.unique(s[order], return_index=True)
    for key, part in zip(keys.tolist(), np.split(order, at[1:]), strict=True):
        for table, kind in ((near, False), (far, True)):
            masks = table.get(key)
            own = part[_odd(fps[part])] if kind else part
            if masks is None or not len(own):
                continue
            variants.append((fps[own][:, None] ^ masks[None, :]).ravel())
            source.append(np.repeat(own, len(masks)))
            is_far.append(np.full(len(own) * len(masks), kind))
    none = np.zeros(0, np.uint64)
    if not variants:
        return none, none
    v, src, kind = np.concatenate(variants), np.concatenate(source), np.concatenate(is_far)
    order = np.argsort(v, kind="stable")
    v = v[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    met = same.copy()
    met[:-1] |= same[1:]
    order, v = order[met], v[met]
    if not len(v):
        return none, none
    src, kind = src[order], kind[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    group = np.cumsum(new) - 1
    # the smallest 1-bit member of each variant is the star's centre
    centre = np.full(group[-1] + 1, len(fps), np.int64)
    np.minimum.at(centre, group[~kind], src[~kind])
    a, b = src, centre[group]
    ok = (b < len(fps)) & (a != b)
    pair = np.unique(a[ok] * np.int64(len(fps)) + b[ok])
    a, b = fps[pair // len(fps)], fps[pair % len(fps)]
    ok = np.bitwise_count(a ^ b) <= RADIUS
    return a[ok], b[ok]


def links(fps: DataFrame, direct: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to join all that are within RADIUS. direct: only pairs
    that are within RADIUS themselves, the first of each bucket and a; not all that it takes to join them."""
    ship(fps.sparkSession)
    n = fps.agg(F.count("fp")).first()[0]
    bits = max(6, math.ceil(math.log2(max(1, n) * (len(NEAR) + len(FAR) / 2) / BUCKET_VARIANTS)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.array(sorted(_by_syndrome(NEAR, bits)), np.int64)
        far = np.array(sorted(_by_syndrome(np.concatenate([NEAR, FAR]), bits)), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            odd = _odd(fp)
            to, what = [], []
            for part, table in ((fp[~odd], near), (fp[odd], far)):
                to.append((_linear(part, bits)[:, None] ^ table[None, :]).ravel())
                what.append(np.repeat(part, len(table)))
            to, what = np.concatenate(to), np.concatenate(what)
            order = np.argsort(to, kind="stable")
            keys, at = np.unique(to[order], return_index=True)
            blobs = [x.tobytes() for x in np.split(what[order], at[1:])] if len(keys) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
        if direct:
            a, b = bucket_pairs(fp, key[0].as_py(), bits)
            a, at = np.unique(a, return_index=True)
            b = b[at]
        else:
            a, b = bucket_links(fp, key[0].as_py(), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return fps.select("fp").where("fp is not null").mapInArrow(spread, "bucket long, fps binary").groupBy("bucket").applyInArrow(gather, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row: component_id is the smallest id reachable over links."""
    return components(fingerprints(docs, id, text), id)


def components(fps: DataFrame, id: str = "doc_id") -> DataFrame:
    fps = materialise(fps, "fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min(id).alias("own")), "nodes")
    tree = connected_components(links(nodes))
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("own").alias("component_id")), "least")
    of = materialise(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(of, "fp").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows, all columns as they are: the row with the smallest id (null ids come last).
    Rows that repeat an id are rows of their own, each in the group of its text; of those that repeat a group's smallest
    id the one with the smallest fingerprint stays, and of equal ones the first as read."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = components(fingerprints(rows, "_row", text), "_row").join(rows.select("_row", F.col(id).alias("_id")), "_row")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "fingerprint", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    return rows.join(materialise(kept, "kept"), "_row", "left_semi").drop("_row")
