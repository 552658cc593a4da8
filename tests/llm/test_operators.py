"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.llm import html_text, line_dedup, mixing, packing, quality, simhash, sstable, substring, tokens, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, t string, g long, id long, rest string"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.3:
            a = rng.randint(0, 30)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(15, 30)]
        t = "".join(x + rng.choice([" ", " ", "\n", "\t ", " \x1c "]) for x in w)
        rows.append([i * 3, t])
    rows[5][1], rows[6][1], rows[7][1], rows[8][1] = None, "", " \n\t ", "one"
    rows[9][1] = rows[10][1] = rows[11][1]
    rows[12][1] = " ".join(rng.choice(vocab) for _ in range(30_000))
    rows[13][1] = "a b c d e f g " * 40
    rows[14][1] = "The same long line of text here\n" * 3 + "x"
    rows[15][1] = " the SAME long line of text here \nother line that stays where it is"
    rows[16][1] = "THE same LONG line of text here"
    return [(i, t, "en", f"src{i % 7}", 1, "clash", 1, 2, "r") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return WORD.findall(t or "")


def test_quality_measures(docs, rows):
    got = {r.doc_id: r for r in quality.quality_measures(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
        cov = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_order_does_not_change_verdicts(docs):
    a = {r.doc_id: r.kept for r in quality.quality_measures(docs, rules=quality.RULES).collect()}
    b = {r.doc_id: r.kept for r in quality.quality_measures(docs, rules=quality.RULES[::-1]).collect()}
    assert a == b
    ordered = quality.order_rules([b"a b c d e f g h i j k l ### ### ###"] * 5)
    assert {n for n, _, _ in ordered} == {r.name for r in quality.RULES}
    assert ordered[0][2] / ordered[0][1] >= ordered[-1][2] / ordered[-1][1]


def test_quality_filter_keeps_columns(docs):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_measures(docs).where("kept").collect()}


def brute_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    root = brute_components(fp)
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root.values())


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(2)
    points = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64):
        for _ in range(15):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            points.add(x)
    fp = dict(enumerate(sorted(points)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fp.items()], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.components(df).collect()} == brute_components(fp)


def test_line_dedup(docs, rows):
    got = {r.doc_id: r for r in line_dedup.digest(line_dedup.drop_lines(docs)).collect()}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    dropped = 0
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(lines) - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        dropped += len(lines) - len(kept)
    assert dropped
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_line_index_is_reversible(spark, docs):
    first = docs.where("doc_id < 45")
    index = line_dedup.LineIndex.create(spark, shards=3).insert(first)
    grown = index.insert(docs.where("doc_id >= 45"))
    back = grown.delete(docs.where("doc_id >= 45").select("doc_id"))
    state = lambda x: sorted((r.shard, bytes(r.key), r.doc) for r in x.postings().collect())
    assert state(back) == state(index)
    whole = {r.doc_id: r.n_dropped for r in line_dedup.drop_lines(docs).collect()}
    by_index = Counter(r.doc for r in grown.drops(docs).collect())
    assert set(by_index) == {i for i, n in whole.items() if n}
    after = Counter(r.doc for r in back.drops(first).collect())
    assert set(after) == {r.doc_id for r in line_dedup.drop_lines(first).collect() if r.n_dropped}

    def tables(x):
        shards = {r.shard: line_dedup.Shard.load(r.state, 3) for r in x.states().collect()}
        return {k: s.table.tolist() for k, s in shards.items() if len(s.table)}, {k: sorted(s.filter.table[s.filter.table > 0].tolist()) for k, s in shards.items()}

    # tables are as at the start, and so are the marks in the filters
    assert tables(back) == tables(index) != tables(grown)
    # a document that is inserted again is replaced
    again = back.insert(first.where("doc_id = 45 or doc_id = 42").withColumn("text", F.lit("THE same LONG line of text here")))
    assert {r.doc for r in again.postings().collect() if r.doc in (42, 45)} == {42}


def test_lines_are_dropped_by_the_filter():
    h = np.zeros(4, line_dedup._ASK)
    h["k"], h["n"], h["top"] = [1 << 40, 2 << 40, 3 << 40, 3 << 40], [3, 2, 5, 1], [7, 8, 9, 4]
    h["k2"] = [1, 1, 1, 2]
    shard = line_dedup.Shard()
    shard.update(h)
    assert [x.tolist() for x in shard.probe(h)] == [[0, 2], [7, 9]]
    # without the filter nothing is found, whatever the table holds
    shard.filter = line_dedup.CuckooFilter(64)
    assert [x.tolist() for x in shard.probe(h)] == [[], []]
    shard = line_dedup.Shard()
    shard.update(h)
    start = shard.dump()
    more = h[:2].copy()
    more["n"], more["top"] = [4, 3], [10, 10]
    shard.update(more)
    assert [x.tolist() for x in shard.probe(h)] == [[0, 1, 2], [10, 10, 9]]
    shard.update(h[:2])
    assert shard.dump() == start


def test_cuckoo_filter():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter(len(h))
    f.add(h)
    assert f.contains(h).all()
    f.remove(h[:2000])
    assert f.contains(h[2000:]).all() and f.contains(h[:2000]).mean() < 0.01
    g = line_dedup.CuckooFilter.load(f.dump())
    assert (g.contains(h) == f.contains(h)).all()


def test_substring_dedup(docs, rows):
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    seen, marked = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        marked[i] = (w, gone)
    assert sum(len(g) for _, g in marked.values()) > 200
    for i, (w, gone) in marked.items():
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].text == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_segment_cache_equals_library():
    rng = random.Random(4)
    odd = ["", "  a  b", " a\n\nb \n c\td", "a\x00b c", "x <|endoftext|> y", "é à́ b c  d", "it's I'LL 123 45  6\n", "a ́b", "İstanbul ΑΣ 's 't", "\x1c a\x1c b\x85c", "ﬁ ½", "word. word, word! two.. ,a"]
    odd += ["".join(rng.choice("ab  \n\t'é!1.,́S") for _ in range(rng.randint(1, 25))) for _ in range(800)]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e = tokens.Encoder(tokens.vocabulary(name), drops)
        for t, ids in zip(odd, e.ids_of(odd), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == e.tokenizer.encode(t, add_special_tokens=False).ids


def library_ids(name):
    t = tokens.Encoder(tokens.vocabulary(name), False).tokenizer
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_tables(docs, rows):
    manifest = sstable.write(docs)
    got = {r.doc_id: r for r in sstable.digests(sstable.read(manifest)).collect()}
    ids_of, start = library_ids("byte_bpe_50k.json"), 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*ids_of(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = sstable.lookup(manifest, [33, 34])
    assert list(found[33][0]) == [*ids_of(rows[11][1]), 0] and not found[34]
    every = sstable.lookup(manifest, [i for i, *_ in rows])
    assert all(list(every[i][0]) == [*ids_of(t), 0] and len(every[i]) == 1 for i, t, *_ in rows)
    odd = docs.sparkSession.createDataFrame([(None, "a"), (7, "b"), (7, "c d"), (-3, None)], "doc_id long, text string")
    found = sstable.lookup(sstable.write(odd), [None, 7, -3, 8])
    assert {i: sorted(map(list, x)) for i, x in found.items()} == {None: [[*ids_of("a"), 0]], 7: sorted([[*ids_of("b"), 0], [*ids_of("c d"), 0]]), -3: [[0]], 8: []}


def test_shard_round_trip_with_null_and_repeated_keys(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    docs = [(None, rng.integers(0, 60000, 5)), (-7, rng.integers(0, 60000, 0)), *((5, rng.integers(0, 60000, 20_000)) for _ in range(4)), (1 << 40, rng.integers(0, 60000, 3))]
    path = str(tmp_path / "x.sst")
    with pa.OSFile(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i, ids in docs:
            w.add(sstable.key_of(i), ids.astype("<u4"))
        w.close()
    with pa.OSFile(path) as f:
        r = sstable.Reader(f)
        assert [(sstable.id_of(k), list(x)) for k, _, x in r] == [(i, list(x)) for i, x in docs]
        assert len(r.get(5)) == 4 and len(r.get(None)) == 1 and len(r.get(-7)) == 1 and r.get(6) == []


def test_packing(docs, rows):
    got = packing.pack(docs, with_ids=True).collect()
    ids_of = library_ids("word_bpe_49k.json")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t, *_ in rows:
        ids, at = [*ids_of(t), 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(own), own)
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by_seq) <= total // 4096 + 2
    assert {tuple(r) for r in packing.pack(docs).collect()} == {tuple(r)[:-1] for r in got}


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(3)
    size = np.arange(1, 65)
    demand = rng.integers(1, 300, 64)
    used, bound = packing.cutting_stock(size, demand, 64)
    assert (sum(c * m for c, m in used) == demand).all() and all((c * size).sum() <= 64 for c, _ in used)
    assert sum(m for _, m in used) <= 1.02 * bound + 2
    with pytest.warns(UserWarning, match="at least"):
        used, bound = packing.cutting_stock(size, demand, 64, gap=0.0, rounds=1)
    assert (sum(c * m for c, m in used) == demand).all() and sum(m for _, m in used) >= bound


def test_mixing(spark, docs, rows):
    got = mixing.select(docs, 0.7, seed=3, max_epochs=2, domains={"d0": 4, "d1": 1}).collect()
    size = {i: len(words(t)) for i, t, *_ in rows}
    total = sum(size.values())
    assert all(0 < r.taken <= r.tokens == size[r.doc_id] and 0 <= r.epoch < 2 for r in got)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    taken = sum(r.taken for r in got)
    assert taken == int(total * 0.7)
    # at most one document of a leaf and epoch is cut, and no later epoch begins before all documents are taken
    cut = Counter((r.source, r.epoch) for r in got if r.taken < r.tokens)
    assert max(cut.values()) == 1
    out = mixing.mix(docs, 0.7, seed=3, max_epochs=2, domains={"d0": 4, "d1": 1})
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got)


def test_budgets_pass_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "p", 100), ("a", "x", "q", 10), ("a", "y", "r", 100), ("b", "x", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 200, 1).collect()}
    # b and a get 100 each; x and y 50 each; q can give 10, so p has 40
    assert got == {"p": 40, "q": 10, "r": 50, "s": 100}
    got = {r.source: r.budget for r in mixing.budgets(leaves, 600, 1).collect()}
    # a can give 210 only; b has the rest
    assert got == {"p": 100, "q": 10, "r": 100, "s": 390}
    # what rounding leaves is handed out; a weight of nothing gets nothing, and its siblings have its share
    for weights in ({"p": 3, "q": 3, "r": 1}, {"p": None, "q": 2, "r": float("nan"), "s": 0.1}, {"p": 0, "s": -1}):
        for total in (0, 1, 2, 7, 97, 301, 1009, 5000):
            got = {r.source: r.budget for r in mixing.budgets(leaves, total, 1, {"b": 2}, {"y": 3}, weights).collect()}
            able = sum(c for k, c in (("p", 100), ("q", 10), ("r", 100), ("s", 1000)) if mixing.whole_weight(weights.get(k, 1)))
            assert sum(got.values()) == min(total, able) and all(got[k] == 0 for k, v in weights.items() if not mixing.whole_weight(v)), (weights, total, got)


def test_mix_takes_rows_one_by_one_and_minds_no_names(spark):
    words = " ".join("w" * 50)
    rows = [(1, "a " * 40, "en", "s1", 0, 0), (1, "b " * 10, "en", "s1", 1, 1), (1, "b " * 10, "en", "s1", 2, 2), (2, words, "en", "s1", 3, 3), (None, words, None, None, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _times int, _K int")
    for share, epochs in ((0.2, 1), (0.5, 2), (0.9, 3), (1.0, 1), (2.0, 3)):
        picks = Counter((r.doc_id, r.tokens) for r in mixing.select(docs, share, max_epochs=epochs).collect())
        out = mixing.mix(docs, share, max_epochs=epochs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert Counter((r[0], len(r[1].split())) for r in got) == picks
        assert set(got) <= set(rows)
    assert max(Counter(r[4] for r in mixing.mix(docs, 1.0, max_epochs=1).collect()).values()) == 1


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])], "x") for i in range(300)]
    rows[10] = (10, None, "x")
    rows[20] = (20, [float("nan")] + [0.0] * 7, "x")
    rows[40] = (40, [0.0] * 8, "x")
    rows[60] = (60, [1.0, None] + [0.0] * 6, "x")
    rows[80] = (80, [1.0, 2.0], "x")
    rows += [(1000 + i, [5.0] * 8, "x") for i in range(30)] + [(100, rows[100][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.expr("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = {}
    for i, e, _ in rows:
        if e and all(x is not None and np.isfinite(x) for x in e):
            v[i] = [int(np.floor(64 * x)) for x in e]
    for q in (i for i in v if i % 20 == 0):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q])))[:7]
        assert sorted(got.get(q, [])) == [(n + 1, c, -s) for n, (s, c) in enumerate(want)]


def test_top_k_of_very_large_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.choice([0, 6, 9, 17, 40])]) for i in range(60)] + [(60, [1e17, 1e17, 0.0]), (61, [1.7e308, -1.7e308, 1e300]), (62, [-1e308, 5.0, 0.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("vec_id % 20 = 0"), k=9).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    most, top = topk.LARGEST, (1 << 63) - 1
    v = {i: [int(max(-most, min(most, np.floor(64 * np.float64(x))))) for x in e] for i, e in rows}
    for q in (0, 20, 40, 60):
        s = {c: sum(a * b for a, b in zip(v[q], v[c], strict=True)) for c in v if c != q}
        near = {c: max(-top, min(top, x)) for c, x in s.items()}
        want = sorted(s, key=lambda c: (-near[c], -topk._double(s[c]), c))[:9]
        assert sorted(got[q]) == [(n + 1, c, near[c]) for n, c in enumerate(want)]


def test_search_block_prunes_without_loss():
    rng = np.random.default_rng(1)
    c = rng.integers(-200, 200, (500, 16)).astype(float)
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    q = c[:40] + rng.integers(-20, 20, (40, 16))
    whole = q @ c.T
    for level in (1, 5, 20):
        bound = np.sort(whole, axis=1)[:, -level]
        for i, at, s, _ in topk.search_block(q, np.full(40, -1), bound, c, np.arange(500), 20):
            want = sorted(((-whole[i, j], j) for j in range(500) if whole[i, j] >= bound[i]))[:20]
            assert sorted(zip((-s).tolist(), at.tolist(), strict=True)) == want


PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header>Site, head</header><nav><a href="/">Home</a></nav>
<div class="ad">Buy, now, please</div><div class="cookie-notice">We use, cookies</div><article><h1>Title &amp; more</h1><p>First,  paragraph with <b>bold
text<p>Second one, unclosed, <a href="x">link</a> &lt;here&gt;</p><ul><li>one<li>two</ul><form>name</form><script>var a = "</p>";</script>
<div id="comments"><p>Nice, post, really, good</p></div></article><aside><p>Aside, text, with, commas</p></aside><footer>&copy; x</footer></body>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more First, paragraph with bold text Second one, unclosed, link <here> one two"
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<p></p>")
    assert html_text.main_text("<p>cut, off in the mid") == "cut, off in the mid"
    assert html_text.main_text("plain &eacute; text") == "plain é text"
    body = "<div class='wrap'><div class=side><a href=a>x, y</a></div><div class=main>" + "<p>Long, plain, prose with words in it, again.</p>" * 20 + "</div></div>"
    assert html_text.main_text(body).count("Long") == 20 and "x, y" not in html_text.main_text(body)


def test_toxicity(spark):
    rng = random.Random(0)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(800):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["gruk", "blivz", "skarm"])
        docs.append((i, " ".join(w), 1))
        labels.append((i, int(bad)))
    docs += [(2000, None, 1), (2001, "", 1), (2002, "gruk " * 20_000, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, y).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) >= len(held)
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2002].predicted == 1
    # the labels of held-out rows have no part in any score
    turned = spark.createDataFrame([(i, 1 - t if i in set(held) else t) for i, t in labels], "doc_id long, toxic int")
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in toxicity.score(d, turned).collect()}
    none = toxicity.score(d, y.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_empty_tables(spark, empty):
    y = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        toxicity.score(empty, y), simhash.near_duplicates(empty), simhash.keep_one(empty), sstable.digests(sstable.read(sstable.write(empty))), quality.quality_measures(empty), mixing.select(empty, 0.9),
        line_dedup.drop_lines(empty), packing.pack(empty), substring.remove_repeats(empty), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.expr("vec_id % 20 = 0")),
        html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.collect() == []


def test_repeated_and_null_ids_do_not_crash(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v"), (1, "a b c d e f g h i j k l m n o p q r s t u v"), (None, "x y"), (None, None), (2, "same line of twenty or more\nz")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(d, y).count() == 5
    assert quality.quality_measures(d).count() == 5
    assert line_dedup.drop_lines(d).count() == 5
    assert sorted(r.n_removed for r in substring.remove_repeats(d).collect()) == [0, 0, 0, 0, 22]
    assert packing.pack(d).count() == 5
    assert sstable.read(sstable.write(d)).count() == 5
    assert simhash.near_duplicates(d).count() == 5
    assert mixing.select(d.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")), 1.0).count() == 4
