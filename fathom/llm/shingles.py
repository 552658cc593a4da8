"""Near copies by the Jaccard similarity of word shingles: every pair at or above the threshold is found, none below it.

A text is the set of its distinct 5-word shingles (64-bit hashes, A-Z lower-cased; a shorter text is one shingle). Rows
with equal sets are one node. Candidates come by meet-in-the-middle ball hashing first, as in simhash: every node has a
fingerprint of its shingles, and pairs that the balls show at 3 or fewer differing bits are verified like all others.
At the similarities wanted most pairs are further apart than any ball could reach, so what ball hashing has not
joined comes from an exact prefix filter: with shingles in one global order, two sets at
similarity t or more share one among the first size - ceil(t * size) + 1 of each, their heads. The order puts shingles
that a sample of texts repeats last; any order finds the same pairs, this one makes few candidates. Sizes and the shared
shingle's places bound the overlap further, then the two heads do: what they share, and what lies beyond them. What is
left is verified on the whole texts, so texts travel for few pairs.

Groups are what links reach, so nodes already in one group need no further comparison. Members of a shingle are first
compared with their next few by size. Lists that are longer stay while they hold members of two groups or more, and are
compared over ever wider windows, between groups only, until each list is done.

A shingle that many texts hold is not one task's: in the first round its list is dealt out by salt (the sample tells
which), later in blocks of CELL members, each pair of blocks being a cell of its own.

Null and wordless texts are the empty set, and copies of each other only. Groups are of rows: of each group the row with
the smallest id stays (null ids come last), of rows with this id the one with the smallest hash of its text, and of equal
rows one. docs is read several times, so it should be a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import simhash
from fathom.llm import text as X
from fathom.llm.components import connected_components
from fathom.llm.exchange import bucket_of, split_by
from fathom.session import discard, give_back, materialise, ship, unused

WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted for the order (about this many, one in ORDER_SHARE at least), and shingles that get a rank of their own at most.
ORDER_SAMPLE, ORDER_SHARE, ORDER_RANKS = 10_000, 500, 1 << 18
#: Members of a shingle compared in the first round, and growth of that window a round.
FIRST_WINDOW, WIDER = 4, 8
#: Members in a block of a shingle's list; head shingles in a bucket of the first round; pairs of one text in a task.
CELL, BUCKET, PAIRS = 4096, 1 << 18, 4096
#: Rows of 24 bytes that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000
_ENTRY = np.dtype([("tok", "<i8"), ("node", "<i8"), ("size", "<u4"), ("place", "<u4")])
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, each text's ascending, and the offset of each text (one more at the end)."""
    data = _FOLD[data]
    s, e, first = X.word_bounds(data, offs)
    h = X.word_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
    many = np.diff(first)
    starts = X.gram_starts(first, n)
    short = np.flatnonzero((many > 0) & (many < n))
    g = [X.gram_hashes(h, n)[starts], *(X.gram_hashes(h[first[i] : first[i + 1]], int(many[i])) for i in short)]
    of = np.concatenate([np.searchsorted(first, starts, "right") - 1, short])
    g = np.concatenate(g)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    g, of = g[new], of[new]
    return g, np.searchsorted(of, np.arange(len(offs)))


def _runs(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offs = X.buffers(column)
    for i, j in X.blocks(offs):
        yield shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)


def _fraction(similarity: float) -> tuple[int, int]:
    f = Fraction(similarity).limit_denominator(1000)
    return f.numerator, f.denominator


def window_pairs(key: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, block: np.ndarray, across: np.ndarray, low: np.ndarray, high: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of one list, low <= j - i < high, that may be similar and are not yet in one group; rows are
    sorted by list and size. across: the list's members are compared between its two blocks only."""
    num, den = _fraction(similarity)
    a, b = [], []
    for d in range(int(low.min()) if len(low) else 1, min(high, len(key))):
        i = np.flatnonzero(key[:-d] == key[d:])
        if not len(i):
            break
        i = i[low[i] <= d]
        j = i + d
        overlap = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = (size[i] * den >= num * size[j]) & (group[i] != group[j]) & (overlap * (num + den) >= num * (size[i] + size[j])) & (~across[i] | (block[i] != block[j]))
        a.append(i[ok])
        b.append(j[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _order(texts: DataFrame, rows: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles that the sample repeats, ascending, in how many of its texts each is, and its share of all texts."""
    share = min(1.0, max(ORDER_SAMPLE / max(1, rows), 1 / ORDER_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, _ in _runs(b.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["tok"])

    part = texts.select("_t") if share == 1 else texts.select("_t").sample(share, 11)
    got = part.mapInArrow(run, "tok long").groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "tok").limit(ORDER_RANKS).toArrow()
    tok, c = got.column("tok").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(tok)
    return tok[order], c[order], share


def similar_rows(texts: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(_id, _th, group) for a table (_id, _th, _t) of ids, hashes of texts and texts: rows of one group are linked by
    similar pairs."""
    spark = texts.sparkSession
    ship(spark)
    num, den = _fraction(similarity)
    kind = texts.schema["_id"].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(_order(texts, texts.count(), n))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, _ = ranks.value
        for b in batches:
            at = 0
            for g, offs in _runs(b.column(2), n):
                size = np.diff(offs)
                of = np.repeat(np.arange(len(size)), size)
                c = np.concatenate([[0], np.cumsum(X.mix(g), dtype=np.uint64)]).astype(np.uint64)
                node = X.mix((c[offs[1:]] - c[offs[:-1]]) + size.astype(np.uint64))
                rank = _often(g, known, often)
                g = g[np.lexsort((g, rank, of))]
                head = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                fp = np.array([simhash.folded(s) if len(s) else 0 for s in np.split(g, offs[1:-1])], np.uint64)
                blobs = [g[o : o + m].tobytes() for o, m in zip(offs[:-1].tolist(), head.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(size)), b.column(1).slice(at, len(size)), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(blobs, pa.binary()), pa.array(fp.view(np.int64))], names=["_id", "_th", "node", "size", "head", "fp"])
                at += len(size)
        give_back()

    marks = materialise(texts.select("_id", "_th", "_t").mapInArrow(mark, f"_id {kind}, _th long, node long, size long, head binary, fp long"), "marks")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_th")).alias("k")
    nodes = materialise(marks.groupBy("node").agg(first, F.first("size").alias("size"), F.first("head").alias("head"), F.first("fp").alias("fp")).select("node", F.col("k._id").alias("_id"), F.col("k._th").alias("_th"), "size", "head", "fp"), "nodes")
    members = materialise(marks.select("_id", "_th", "node"), "members")
    discard(marks)

    parts = max(64, nodes.count() >> 16)
    def verified(pairs: DataFrame) -> DataFrame:
        likely = _compared(pairs, nodes.select("node", "size", "head"), lambda: _heads_allow(num, den))
        out = _compared(likely, _texts(texts, nodes, likely), lambda: _sets_agree(n, num, den))
        discard(likely)
        return out

    met = _ball_pairs(nodes)
    links = [verified(met)]
    joined = materialise(connected_components(links[0]), "tree")
    found = materialise(_first_round(nodes, ranks, similarity, parts), "candidates")
    low, high = 1, 1 + FIRST_WINDOW
    while True:
        pairs = found.where("part is not null").groupBy("part").applyInArrow(_distinct, "a long, b long")
        pairs = materialise(_apart(pairs, joined) if low == 1 else pairs, "pairs")  # later rounds know their groups
        links.append(verified(pairs))
        discard(pairs)
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        tree = materialise(connected_components(every), "tree")
        rest = found.where("tok is not null")
        if rest.isEmpty():
            discard(found, nodes, met, joined, *links)
            break
        now = _rest(rest, tree, low, high, similarity, parts)
        discard(found, tree)
        found, low, high = now, high, 1 + (high - 1) * WIDER
    return members.join(tree, members.node == tree.node, "left").select("_id", "_th", F.coalesce("root", members.node).alias("group"))


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b), a < b, whose fingerprints the balls show within simhash.RADIUS: each fingerprint has its smallest
    node, others of the fingerprint pair with that one."""
    of = nodes.where("size > 0").select("node", "fp")
    own = materialise(of.groupBy("fp").agg(F.min("node").alias("own")), "own")
    same = of.join(own, "fp").where("node <> own").select(F.col("own").alias("a"), F.col("node").alias("b"))
    near = simhash.links(own, direct=True).distinct()
    near = near.join(own.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    out = materialise(same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "met")
    discard(own)
    return out


def _apart(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """The pairs whose nodes are not yet in one group of the tree."""
    for end in ("a", "b"):
        t = tree.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(t, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where("a_root <> b_root").select("a", "b")


def _often(g: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """In how many texts of the sample each shingle is; 0 where it is not known."""
    if not len(known):
        return np.zeros(len(g), np.int64)
    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return np.where(known[k] == g, often[k], 0)


#: Pairs come as (part, pairs), packed and dealt by their first node; members of lists that are not done as the others.
_FOUND = "part long, pairs binary, tok long, node long, size long, place long, split boolean"


def _packed(a: np.ndarray, b: np.ndarray, parts: int) -> pa.Table:
    own = split_by(bucket_of(X.mix(a.view(np.uint64)), parts), np.stack([a, b], 1))
    none = pa.nulls(len(own), pa.int64())
    return pa.table({"part": pa.array([k for k, _ in own], pa.int64()), "pairs": pa.array([p[0].tobytes() for _, p in own], pa.binary()), "tok": none, "node": none, "size": none, "place": none, "split": pa.nulls(len(own), pa.bool_())})


def _members(tok, node, size, place, split) -> pa.Table:
    return pa.table({"part": pa.nulls(len(tok), pa.int64()), "pairs": pa.nulls(len(tok), pa.binary()), **{k: pa.array(v) for k, v in (("tok", tok), ("node", node), ("size", size), ("place", place), ("split", split))}})


def _distinct(table: pa.Table) -> pa.Table:
    """Each pair of a part once."""
    x = np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
    a, b = _unique_pairs(np.ascontiguousarray(x.T).ravel(), np.arange(len(x)), np.arange(len(x)) + len(x))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _first_round(nodes: DataFrame, ranks, similarity: float, parts: int) -> DataFrame:
    """Pairs, and (tok, node, size, place, split) of lists that are not done; split: the list was dealt out by salt."""
    total = nodes.agg(F.sum(F.octet_length("head"))).first()[0] or 0
    buckets = max(64, total // 8 // BUCKET + 1)

    def salts(tok: np.ndarray) -> np.ndarray:
        known, often, share = ranks.value
        return (_often(tok.view(np.uint64), known, often) / share / CELL).astype(np.int64) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = b.column(2).to_pylist()
            many = np.fromiter((len(x) // 8 for x in heads), np.int64, len(heads))
            out = np.empty(int(many.sum()), _ENTRY)
            out["tok"] = np.frombuffer(b"".join(heads), np.int64)
            out["node"], out["size"] = (np.repeat(b.column(k).to_numpy(), many) for k in (0, 1))
            out["place"] = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
            salt = out["node"].view(np.uint64) % salts(out["tok"]).astype(np.uint64)
            parts = split_by(bucket_of(X.mix(out["tok"].view(np.uint64) + salt * _U(0x9E3779B97F4A7C15)), buckets), out)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([p[0].tobytes() for _, p in parts], pa.binary())], names=["bucket", "entries"])

    def gather(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY)
        split = salts(x["tok"])
        salt = x["node"].view(np.uint64) % split.astype(np.uint64)
        order = np.lexsort((x["node"], x["size"], salt, x["tok"]))
        x, split, salt = x[order], split[order] > 1, salt[order]
        new = np.ones(len(x), bool)
        new[1:] = (x["tok"][1:] != x["tok"][:-1]) | (salt[1:] != salt[:-1])
        key = np.cumsum(new)
        size, place = x["size"].astype(np.int64), x["place"].astype(np.int64)
        no = np.zeros(len(x), bool)
        i, j = window_pairs(key, size, place, x["node"], no, no, np.ones(len(x), np.int64), 1 + FIRST_WINDOW, similarity)
        a, b = _unique_pairs(x["node"], i, j)
        left = (np.bincount(key)[key] > 1 + FIRST_WINDOW) | split
        return pa.concat_tables([_packed(a, b, parts), _members(x["tok"][left], x["node"][left], size[left], place[left], split[left])])

    sent = nodes.select("node", "size", "head").mapInArrow(send, "bucket long, entries binary")
    return sent.groupBy("bucket").applyInArrow(gather, _FOUND)


def _unique_pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _rest(lists: DataFrame, tree: DataFrame, low: int, high: int, similarity: float, parts: int) -> DataFrame:
    """As _first_round, of lists (tok, node, size, place, split) that still hold two groups: windows of low to high."""
    lists = lists.join(tree, lists.node == tree.node, "left").select("tok", lists.node, "size", "place", "split", F.coalesce(tree.root, lists.node).alias("root"))
    lists = materialise(lists, "lists")
    open_ = lists.groupBy("tok").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = open_.select("tok", F.ceil(F.col("m") / CELL).cast("int").alias("blocks"))
    x = lists.join(open_, "tok").withColumn("blk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # lists go on where the last round stopped; those that the first round had in other parts begin anew
    same = (F.col("blocks") == 1) & ~F.col("split") if low == 1 else F.lit(True)
    x = x.withColumn("low", F.when(same, F.lit(high)).otherwise(F.lit(1)).cast("long"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("tok", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "size", "node", "place", "root", "blk", "low", "split", "blocks")
    wide = 1 + (high - 1) * WIDER
    wide = wide if wide < 4 * CELL else 1 << 62  # the last round compares all that is left of a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tok, i, j, size, node, place, root, blk, least = (t.column(k).to_numpy() for k in range(9))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            key = np.cumsum(new)
            p, q = window_pairs(key, size, place, root, blk, i != j, least, wide, similarity)
            a, b = _unique_pairs(node, p, q)
            yield from _packed(a, b, parts).to_batches()
            # a member of several cells comes back from that of its own block
            left = (i == j) & ((np.bincount(key)[key] > wide) | (t.column(10).to_numpy() > 1) & (wide < 1 << 62))
            split = t.column(9).to_numpy()
            yield from _members(tok[left], node[left], size[left], place[left], split[left]).to_batches()

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = [t.column(k).to_numpy() for k in range(3)]
            same = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]) | (last[2] != last[2][-1]))
            cut = int(same[-1]) + 1 if len(same) else 0
            held = t.slice(cut)
            if cut:
                yield from out(t.slice(0, cut))
        if held is not None:
            yield from out(held)

    x = x.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "size", "node")
    out = materialise(x.mapInArrow(run, _FOUND), "candidates")
    discard(lists)
    return out


def _texts(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes that are in pairs."""
    ends = _ends(pairs)
    rep = nodes.join(ends, "node", "left_semi").select("node", F.col("_id").alias("_i"), F.col("_th").alias("_h"))
    rep = F.broadcast(rep) if ends.count() <= BROADCAST_ROWS else rep
    return texts.join(rep, texts["_id"].eqNullSafe(rep["_i"]) & (texts["_th"] == rep["_h"])).select("node", "_t").dropDuplicates(["node"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _compared(pairs: DataFrame, of: DataFrame, judge: Callable[[], Callable]) -> DataFrame:
    """The pairs (a, b) that judge accepts: it makes a function of batches of what `of` has of nodes, each as it comes, to
    things to compare, and one of two such things. A node with many pairs is in several tasks."""
    ends = _ends(pairs)
    ends = F.broadcast(ends) if pairs.count() <= BROADCAST_ROWS // 2 else ends
    of = materialise(of.join(ends, "node", "left_semi"), "compared")
    own, rest = of.columns[0], of.columns[1:]
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    many = materialise(many, "many")
    mine = many.join(of, many.a == of[own]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), *rest)
    other = pairs.join(many, "a").join(of, F.col("b") == of[own]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        things, agree = judge()
        at, one = None, None
        for batch in batches:
            good = []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), things(batch.columns[3:]), strict=True):
                if b is None:
                    at, one = a, x
                elif at != a:
                    raise RuntimeError("a candidate has nothing to compare")
                elif agree(one, x):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in good], pa.int64()) for c in (0, 1)], names=["a", "b"])

    # a node comes before those it is compared with: nulls sort first
    out = materialise(mine.union(other).repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, "a long, b long"), "agreed")
    discard(of, many)
    return out


def _heads_allow(num: int, den: int) -> tuple[Callable, Callable]:
    def things(columns: list[pa.Array]) -> Iterator[tuple[int, np.ndarray]]:
        for size, head in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
            yield size, np.sort(np.frombuffer(head, np.uint64))

    def agree(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
        # of the head that ends first in the order, what the other head lacks the other set lacks too
        both = len(np.intersect1d(x[1], y[1], assume_unique=True))
        most = both + max(x[0] - len(x[1]), y[0] - len(y[1]))
        return most * (num + den) >= num * (x[0] + y[0])

    return things, agree


def _sets_agree(n: int, num: int, den: int) -> tuple[Callable, Callable]:
    def things(columns: list[pa.Array]) -> Iterator[np.ndarray]:
        for g, offs in _runs(columns[0], n):
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                yield g[lo:hi]

    def agree(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * den >= num * (len(x) + len(y) - both)

    return things, agree


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, all columns as they are."""
    (hash_,) = unused(docs, "hash")
    d = docs.withColumn(hash_, F.xxhash64(F.col(text).cast("string")))
    groups = similar_rows(d.select(F.col(id).alias("_id"), F.col(hash_).alias("_th"), F.col(text).cast("string").alias("_t")), n, similarity)
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_th")).alias("k"), F.count("*").alias("n")).select(F.col("k._id").alias("_id"), F.col("k._th").alias("_th"), "n")
    kept = materialise(kept, "kept")
    # rows that are equal in id and text: of groups of several rows only
    again = groups.join(kept.where("n > 1").select("_id", "_th"), groups["_id"].eqNullSafe(kept["_id"]) & (groups["_th"] == kept["_th"]), "left_semi").groupBy("_id", "_th").count().where("count > 1")
    again = materialise(again.select("_id", "_th"), "again")
    match = lambda k: d[id].eqNullSafe(k["_id"]) & (d[hash_] == k["_th"])
    if again.isEmpty():
        return d.join(kept, match(kept), "left_semi").drop(hash_)
    single = kept.join(again, kept["_id"].eqNullSafe(again["_id"]) & (kept["_th"] == again["_th"]), "left_anti")
    one = d.join(again, match(again), "left_semi").dropDuplicates([id, hash_])
    return d.join(single, match(single), "left_semi").unionByName(one).drop(hash_)
