"""Questions and answers between document groups and hash buckets.

Documents are dealt into groups by a hash of their id, some MB of text each. A group asks buckets about its hashes
(after its own pre-aggregation, so a bucket hears of a hash once from each group however often it repeats), buckets
answer, and answers meet the group's documents again. All of it is one plan, in which the exchange of the documents
is made once and reused, and any lost part can be made again from the exchanges before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import ship

GROUP_BYTES = 4 << 20
LEAST = 64


@dataclass(frozen=True)
class Groups:
    docs: DataFrame  # g, id, text, and where asked for rest: all other columns as a struct
    n_bytes: int
    n_groups: int

    def buckets(self, per_bucket: float, bytes_each: float) -> int:
        """How many buckets hold about per_bucket items each, if there is one item to bytes_each bytes of text."""
        return max(LEAST, int(self.n_bytes / bytes_each / per_bucket) + 1)


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, rest: bool = False, whole_ids: bool = False) -> Groups:
    """whole_ids: rows that repeat an id are in one group; else, and for null ids, they are dealt out by their texts too."""
    ship(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id, text)]
    d = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), *([F.struct(*others).alias("rest")] if rest and others else []))
    n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST, n_bytes // group_bytes + 1)
    by = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")) if whole_ids else F.xxhash64("id", "text")
    return Groups(d.select(F.pmod(by, F.lit(n)).alias("g"), "*"), n_bytes, n)


def in_order(table: pa.Table) -> pa.Table:
    """A group's documents by id (nulls first), rows with the same id by text: the same order each time it is made."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 from the upper 32 bits of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def split_by(keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """Columns cut by key: (key, [part of each column]), keys ascending."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    own, at = np.unique(keys[order], return_index=True)
    cut = [np.split(c[order], at[1:]) for c in columns]
    return [(int(k), [c[i] for c in cut]) for i, k in enumerate(own.tolist())]
