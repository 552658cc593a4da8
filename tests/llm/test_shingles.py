"""Near copies by shingle similarity against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import shingles

from .test_operators import words


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(min(g) for g in groups.values())


def edited(rng, vocab, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(vocab)
    return w


def table():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(80)]
    texts = []
    for k in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 260))]
        texts += [edited(rng, vocab, base, rng.randint(0, max(1, len(base) // 30))) for _ in range(4)]
    base = [rng.choice(vocab) for _ in range(200)]
    texts += [edited(rng, vocab, base, rng.randint(0, 6)) for _ in range(90)]
    texts += [passage + [rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (902, "One two"), (903, "one TWO")]


def test_keep_one_finds_every_similar_pair(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, x int").repartition(3)
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_stage_takes_similarity_of_five_words(spark):
    rng = random.Random(8)
    w = ["w%d" % rng.randrange(5000) for _ in range(248)]
    v = list(w)
    for k in (20, 70, 120, 170, 220):
        v[k] = "edited"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(w[:150]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()) == [1, 3]


def test_ball_hashing_proposes_pairs_and_the_filter_the_rest(spark, monkeypatch):
    rng = random.Random(6)
    w = ["w%d" % rng.randrange(5000) for _ in range(400)]
    near, far = [*w[:-1], "edited"], list(w)
    for k in (60, 150, 260, 340):
        far[k] = "edited"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, "")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 4]
    # by the balls alone: all within their radius, nothing else
    monkeypatch.setattr(shingles, "_first_round", lambda *_: spark.createDataFrame([], shingles._FOUND))
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3, 4]
    # what they show is verified
    every = lambda n: n.select(F.col("node").alias("a")).crossJoin(n.select(F.col("node").alias("b"))).where("a < b")
    monkeypatch.setattr(shingles, "_ball_pairs", every)
    other = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:300])), (3, " ".join(near))], "doc_id long, text string")
    assert sorted(r.doc_id for r in stage(spark, other, "").collect()) == [1, 2]


def test_lists_dealt_in_parts_lose_no_pair(spark, monkeypatch):
    for name, value in (("CELL", 6), ("FIRST_WINDOW", 2), ("WIDER", 2), ("PAIRS", 3), ("BUCKET", 50), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(shingles, name, value)
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == brute_kept(rows)
