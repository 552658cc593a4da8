"""The toxicity model against Kneser-Ney by dictionaries: every n-gram has its own counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from fathom.llm import toxicity


def plain_evidence(counts, words, order=toxicity.ORDER, discount=toxicity.DISCOUNT):
    def places(w):
        x = "\2" + w + "\3"
        for at in range(1, len(x)):
            yield at, [x[at - n + 1 : at + 1] for n in range(1, min(order, at + 1) + 1)]

    grams = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
    for w, c in counts.items():
        for _, g in places(w):
            for n, x in enumerate(g, 1):
                for k in (0, 1):
                    grams[n][x][k] += c[k]
    total, kinds, tails, ends, more = Counter(), Counter(), Counter(), Counter(), Counter()
    for n in range(2, order + 1):
        for x in grams[n]:
            ends[x[1:]] += 1
    for n in range(1, order + 1):
        for x, c in grams[n].items():
            more[n, x[:-1]] += max(ends[x], 1)
            tails[n, x[:-1]] += 1
            for k in (0, 1):
                total[n, x[:-1], k] += c[k]
                kinds[n, x[:-1], k] += c[k] > 0
    out = []
    for w in words:
        e = 0.0
        for at, g in places(w):
            low = 1 / 256
            for n, x in enumerate(g, 1):
                h = x[:-1]
                if n == order or at == n - 1:
                    p = []
                    for k in (0, 1):
                        t = total[n, h, k]
                        p.append(max(grams[n].get(x, [0, 0])[k] - discount, 0) / max(t, 1) + (discount * kinds[n, h, k] / t if t else 1) * low)
                    e += math.log(max(p[1], 1e-12)) - math.log(max(p[0], 1e-12))
                if n < order:
                    m = max(ends[x], 1) if x in grams[n] else 0
                    low = max(m - discount, 0) / max(more[n, h], 1) + (discount * tails[n, h] / more[n, h] if more[n, h] else 1) * low
        out.append(e)
    return np.array(out)


def test_model_counts_every_ngram(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(800)]
    labels = [(i, int(rng.random() < 0.3)) for i in range(800)]
    counts = {}
    for (i, t), (_, y) in zip(docs, labels, strict=True):
        if zlib.crc32(str(i).encode()) % 4 < 2:
            for w in t.split():
                counts.setdefault(w, [0, 0])[y] += 1
    model, _ = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [*vocab[:1500], "unseen", "zzz"]
    got = model.value.evidence(*toxicity._flat([w.encode() for w in asked]))
    assert np.allclose(got, plain_evidence(counts, asked), atol=1e-3)
