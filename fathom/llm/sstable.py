"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    blocks   zstd frames; entries (shared prefix, suffix length, key suffix, number of ids, ids)
    index    for each block: first key, place, packed and raw size, documents, ids before it in the shard
    filter   Bloom filter of the shard's keys
    footer   places of index and filter, number of documents and ids, id width, magic

A key is the big-endian id with its sign bit turned (a null id: the empty key, first of all), so bytes sort like ids.
A lookup asks the Bloom filter, searches the sparse index by halving, and unpacks one block. Files are written under
the folder shared by driver and executors by tasks that may run twice: each attempt has a file name of its own, and a
manifest table lists the files that count, so lost executors or speculation do no harm.

Null text counts as empty and holds the end id only. Rows with the same id stay side by side, in order of their text.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.llm.tokens import encoder, vocabulary
from fathom.session import materialise, new_path, ship

MAGIC = b"FTHMSST1"
BLOCK_IDS = 32_768
BITS_A_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQB7x8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<BQIIIQ")


def key_of(id: int | None) -> bytes:
    return b"" if id is None else (id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(k, "big") ^ len(k) for k in keys], np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)).astype(np.int64)


def file_system(uri: str):
    """(file system, path) of a URI, for driver and executors alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one shard; documents must come in ascending key order. Memory: one block, and the index and keys' hashes."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.codec = sink, width, pa.Codec("zstd", 1)
        self.at = self.n_ids = self.n_docs = self.block_ids = self.block_docs = 0
        self.parts: list[bytes] = []
        self.last = b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.first_key = self.block_first = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block_docs:
            self.block_first, self.block_start, self.last = key, self.n_ids, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.parts += [_ENTRY.pack(shared, len(key) - shared, len(ids)), key[shared:], ids.astype(f"<u{self.width}").tobytes()]
        if not self.n_docs:
            self.first_key = key
        self.last = key
        self.keys.append(key)
        self.n_docs += 1
        self.block_docs += 1
        self.n_ids += len(ids)
        self.block_ids += len(ids)
        if self.block_ids >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.block_docs:
            raw = b"".join(self.parts)
            packed = self.codec.compress(raw, asbytes=True)
            self.sink.write(packed)
            self.index.append(_INDEX.pack(len(self.block_first), self.at, len(packed), len(raw), self.block_docs, self.block_start) + self.block_first)
            self.at += len(packed)
            self.parts, self.block_ids, self.block_docs = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BITS_A_KEY * len(self.keys))
        table = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 65536):
            table[_probes(self.keys[i : i + 65536], bits).ravel()] = True
        bloom = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(_FOOTER.pack(self.at, len(index), len(bloom), self.n_docs, self.n_ids, self.width, MAGIC))


class Reader:
    """Reads one shard from a seekable source."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.index_at, self.index_len, bloom_len, self.n_docs, self.n_ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw = self._read(self.index_at, self.index_len)
        self.bloom = self._read(self.index_at + self.index_len, bloom_len)
        self.keys, self.blocks, at = [], [], 0
        while at < len(raw):
            n, *block = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.keys.append(raw[at : at + n])
            self.blocks.append(block)
            at += n

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of a block's documents."""
        at, packed, size, n, start = self.blocks[k]
        raw = pa.Codec("zstd").decompress(self._read(at, packed), size, asbytes=True)
        at, last = 0, b""
        for _ in range(n):
            shared, rest, m = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            last = last[:shared] + raw[at : at + rest]
            at += rest
            yield last, start, np.frombuffer(raw, f"<u{self.width}", m, at)
            at += m * self.width
            start += m

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        bits = struct.unpack_from("<Q", self.bloom)[0]
        return all(self.bloom[8 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _probes([key], bits)[0].tolist())

    def get(self, id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids before it in the shard, ids) of each document with this id."""
        key = key_of(id)
        if not self.may_hold(key):
            return []
        k = max(0, bisect_right(self.keys, key) - 1)
        while k and self.keys[k] == key:  # the key may start in an earlier block
            k -= 1
        out = []
        while k < len(self.blocks) and self.keys[k] <= key:
            out += [(s, i) for x, s, i in self.block(k) if x == key]
            k += 1
        return out


MANIFEST = "file string, first_id long, has_null boolean, n_docs long, n_ids long"


def write(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int = 0, drops_space: bool = False) -> DataFrame:
    """Encodes every text, appends end_id, and writes shards under path. Returns the manifest."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    path, vocab = path or new_path(spark, "tokens"), vocab or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, drops_space)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        fs, root = file_system(path)
        writer = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, texts = b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()
                for i, raw in zip(ids, enc.ids_of(texts), strict=True):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        name = f"shard-{uuid.uuid4().hex}.sst"
                        writer = Writer(fs.open_output_stream(f"{root}/{name}"), width)
                    writer.add(key_of(i), np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            writer.sink.close()
            first = id_of(writer.first_key)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([first], pa.int64()), pa.array([first is None]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=["file", "first_id", "has_null", "n_docs", "n_ids"])

    d = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(d.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the manifest's files; start: ids of all documents before it."""
    spark = manifest.sparkSession
    ship(spark)
    # one row a shard: a few thousand for many TB
    placed = manifest.withColumn("before", F.sum("n_ids").over(W.orderBy(F.col("has_null").desc(), "first_id").rowsBetween(W.unboundedPreceding, -1)))
    placed = placed.select("file", F.coalesce("before", F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = file_system(file)
                with fs.open_input_file(p) as source:
                    shard = Reader(source)
                    for k in range(len(shard.blocks)):
                        rows = list(shard.block(k))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([id_of(x) for x, _, _ in rows], pa.int64()), pa.array([before + s for _, s, _ in rows], pa.int64()), pa.array([len(i) for _, _, i in rows], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, _, i in rows], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    n = max(1, spark.sparkContext.defaultParallelism)
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Ids of single documents: the manifest's key ranges tell which shards can hold them, and tasks search those."""
    spark = manifest.sparkSession
    ship(spark)
    wanted = sorted({i for i in ids if i is not None})
    # one row a shard; equal ids are in one shard
    following = F.lead("first_id").over(W.orderBy(F.col("has_null").desc(), "first_id"))
    own = lambda i: (F.col("first_id").isNull() | (i >= F.col("first_id"))) & (F.col("next_id").isNull() | (i < F.col("next_id")))
    asked = F.filter(F.array(*(F.lit(i).cast("long") for i in wanted)), own) if wanted else F.array().cast("array<long>")
    shards = manifest.withColumn("next_id", following).select("file", asked.alias("ids"), (F.col("has_null") & F.lit(None in ids)).alias("nulls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, own_ids, nulls in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, p = file_system(file)
                with fs.open_input_file(p) as source:
                    shard = Reader(source)
                    rows = [(i, x.astype("<u4").tobytes()) for i in [*own_ids, *([None] if nulls else [])] for _, x in shard.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["id", "ids"])

    hit = shards.where("size(ids) > 0 or nulls").repartition(max(1, spark.sparkContext.defaultParallelism))
    out: dict[int | None, list[np.ndarray]] = {i: [] for i in ids}
    for r in hit.mapInArrow(run, "id long, ids binary").collect():  # the documents asked for
        out[r.id].append(np.frombuffer(bytes(r.ids), "<u4"))
    return out


def digests(rows: DataFrame, crc: str = "ids_crc32") -> DataFrame:
    """read()'s rows with the CRC-32 of the ids in their place."""
    return rows.withColumn(crc, F.crc32("ids")).drop("ids")


__all__ = ["Reader", "Writer", "digests", "lookup", "read", "write"]
