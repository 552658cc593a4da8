"""Operators against second, plain versions: Kneser-Ney with exact counts, quality verdicts, tree scoring."""

import html
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from fathom.llm import html_text, quality, toxicity

from .test_operators import corpus, words

START, END = b"\x02", b"\x03"


class PlainModel:
    """The two models from counts {word: (ordinary, toxic)}, by dictionaries of character n-grams."""

    def __init__(self, counts, order, discount):
        self.order, self.d = order, discount
        self.n = [{} for _ in range(order + 1)]
        for w, c in counts.items():
            s = START + w + END
            for r in range(1, len(s)):
                for n in range(1, min(order, r + 1) + 1):
                    x = self.n[n].setdefault(s[r - n + 1 : r + 1], [0, 0])
                    x[0], x[1] = x[0] + c[0], x[1] + c[1]

    def kinds_before(self, g):
        return max(1, sum(1 for x in self.n[len(g) + 1] if x[1:] == g))

    def shared(self, g):
        if not g:
            return 1 / 256
        low = self.shared(g[1:])
        same = {x: self.kinds_before(x) for x in self.n[len(g)] if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return low
        return max(same.get(g, 0) - self.d, 0) / total + self.d * len(same) / total * low

    def own(self, g, c):
        low = self.shared(g[1:])
        same = {x: k[c] for x, k in self.n[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return low
        return max(same.get(g, 0) - self.d, 0) / total + self.d * sum(1 for k in same.values() if k) / total * low

    def evidence(self, w):
        s, out = START + w + END, 0.0
        for r in range(1, len(s)):
            g = s[max(0, r + 1 - self.order) : r + 1]
            out += math.log(self.own(g, 1)) - math.log(self.own(g, 0))
        return out


def test_evidence_is_that_of_the_plain_model():
    rng = random.Random(3)
    vocab = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    counts = {w: (rng.randrange(6), rng.randrange(4)) for w in vocab}
    counts = {w: c for w, c in counts.items() if sum(c)}
    model = toxicity.Model(toxicity.gram_counts(list(counts), np.array(list(counts.values()))))
    plain = PlainModel(counts, toxicity.ORDER, toxicity.DISCOUNT)
    asked = [*list(counts)[:25], b"a", b"dcba", b"zzz", b"abcdabcdabcd", bytes([0xC3, 0xA9])]
    got = model.evidence(*toxicity._flat(asked))
    for w, x in zip(asked, got, strict=True):
        assert x == pytest.approx(plain.evidence(w), rel=1e-4, abs=1e-4), w


def brute_kept(t):
    t, w = t or "", words(t)
    n = len(w)
    grams = Counter(tuple(w[j : j + 5]) for j in range(n - 4))
    cov = {k for j in range(n - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    if n < 10 or 100 * len(cov) > 20 * n:
        return False
    lines = [x for x in t.split("\n") if words(x)]
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    return not (
        sum(not re.search(r"[a-zA-Z]|[^\x00-\x7f]", x) for x in w) > 0.5 * n or max(Counter(w).values()) > 0.3 * n or sum(a == b for a, b in zip(w, w[1:])) > 0.3 * n
        or up > 0.5 * (up + low) or t.count("!") > 0.2 * n or sum(c in "#*$%&|<>" for c in t) > 0.1 * n
        or sum(map(len, w)) < 2 * n or sum(map(len, w)) > 20 * n or len(lines) - len(set(lines)) > 0.5 * (t.count("\n") + 1)
    )


def test_quality_verdicts(spark):
    rng = random.Random(6)
    base = [t for _, t, *_ in corpus(80, 4)]
    names = ["word%d" % i for i in range(300)]
    some = lambda k: [rng.choice(names) for _ in range(k)]
    odd = []
    for k in range(60):
        w = some(40)
        cut, bad = rng.randint(0, 40), ["12", "SHOUTED", "so!", "#tag|", "x", "é", "same"][k % 7]
        w[:cut] = [bad + (str(j) if k % 2 and bad != "same" else "") for j in range(cut)]
        if k % 3:
            rng.shuffle(w)
        odd.append(" ".join(w))
    odd += ["\n".join(rng.choice(names[:12]) for _ in range(40)) for _ in range(9)] + ["x" * 400 + " " + " ".join(some(k)) for k in range(8, 30)]
    rows = list(enumerate([*base, *odd, None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in quality.quality_measures(docs).collect()}
    assert {i: r[-1] for i, r in got.items()} == {i: brute_kept(t) for i, t in rows}
    assert 20 < sum(r[-1] for r in got.values()) < len(rows) - 20
    # each rule alone rejects something that passes the base measures
    m = quality.measure(docs.toArrow().column("text").combine_chunks())
    texts = [(t or "").encode() for _, t in rows]
    for rule in quality.RULES:
        assert (rule.rejects(texts, m) & ~quality.base_failed(m)).any(), rule.name
    documents = docs.toArrow()  # noqa: F841  (DuckDB finds it by name)
    assert {r[0]: tuple(r) for r in duckdb.sql(quality.sql()).fetchall()} == got


class Tree(HTMLParser):
    """Elements as [name, dropped, parent, children], texts as strings, of pages with all tags closed."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["#root", False, None, []]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        new = [tag, self.at[1] or tag in ("nav", "footer", "aside", "header") or dict(attrs).get("class") in ("ad", "cookie-notice"), self.at, []]
        self.at[3].append(new)
        self.at = new

    def handle_endtag(self, tag):
        self.at = self.at[2]

    def handle_data(self, data):
        self.at[3].append(data)


def plain_main_text(page):
    """Walks up from each block and down again, in no hurry."""
    blocks = []

    def collect(x):
        run = []

        def flush():
            s = " ".join("".join(t for t, _ in run).split())
            if s and not x[1]:
                blocks.append((s, min(sum(len(t) for t, a in run if a), len(s)), x))
            run.clear()

        for y in x[3]:
            if isinstance(y, str):
                run.append((y, False))
            elif y[0] in ("a", "b"):
                run.extend((t, y[0] == "a") for t in y[3])
            else:
                flush()
                collect(y)
        flush()

    root = Tree(page).root
    collect(root)
    if not blocks:
        return ""
    up = lambda x: [] if x is None else [x, *up(x[2])]
    prose = ("p", "blockquote", "h1", "h2")
    score = {}
    for s, linked, x in blocks:
        points = (1 + s.count(",") + min(len(s) // 100, 3)) * (1 - linked / len(s))
        leaf = x[0] in ("div", "section") and not any(not isinstance(y, str) and y[0] not in ("a", "b") for y in x[3]) and len(s) >= 80
        first = x[2] if x[0] in prose or leaf else x
        for share, y in zip((1, 1 / 2, 1 / 6, 1 / 9, 1 / 12), up(first), strict=False):
            score[id(y)] = score.get(id(y), 0) + points * share

    def inside(x):
        return [b for b in blocks if any(y is x for y in up(b[2]))]

    def density(x):
        own = inside(x)
        return sum(b[1] for b in own) / sum(len(b[0]) for b in own) if own else 1.0

    def final(x):
        return score.get(id(x), 0) * (1 - density(x)) if inside(x) else 0.0

    def every(x):
        return [x, *(z for y in x[3] if not isinstance(y, str) and y[0] not in ("a", "b") for z in every(y))]

    best = max((x for x in every(root) if not x[1] and inside(x)), key=final)
    most = final(best)
    while best[2] is not None and best[0] in ("ul", "li", "blockquote", "p"):
        best = best[2]
    while best[2] is not None and best[2][0] in ("article", "main"):
        best = best[2]
    chosen, beside = [best], None
    if best[2] is not None and best[0] not in ("article", "main", "body"):
        beside = best[2]
        for x in beside[3]:
            if not isinstance(x, str) and x[0] not in ("a", "b") and density(x) < 0.25 and (x[0] in prose and inside(x) or final(x) >= max(10, 0.2 * most)):
                chosen.append(x)
    return " ".join(s for s, _, x in blocks if x is beside or any(y is c for y in up(x) for c in chosen))


def random_page(rng):
    text = lambda: ", ".join(" ".join("w%d" % rng.randrange(99) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))) + rng.choice(["", " &amp; é", "\n\t x"])

    def block(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.45:
            tag = rng.choice(["p", "p", "p", "h1", "h2", "div", "blockquote"])
            inner = text() + (f' <a href="x">{text()}</a> ' if rng.random() < 0.3 else "") + (f"<b>{text()}</b>" if rng.random() < 0.2 else "")
            return f"<{tag}>{inner}</{tag}>"
        if kind < 0.55:
            return f"<{(tag := rng.choice(['nav', 'footer', 'aside', 'header']))}>{text()}{block(depth + 1)}</{tag}>"
        if kind < 0.6:
            return f'<div class="{rng.choice(["ad", "cookie-notice"])}">{text()}{block(depth + 1)}</div>'
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        tag = rng.choice(["div", "div", "section", "article", "main"])
        return f"<{tag}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 5))) + (text() if rng.random() < 0.1 else "") + f"</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randint(1, 6))) + "</body></html>"


def test_main_text_is_that_of_the_plain_scorer():
    rng = random.Random(1)
    texts = 0
    for _ in range(400):
        page = random_page(rng)
        want = plain_main_text(page)
        assert html_text.main_text(page) == want, page
        texts += want != " ".join(html.unescape(re.sub("<[^>]*>", " ", page)).split())
    assert texts > 100


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        page = "<div>" * n + "text, here" + "</section>" * n + "<li>x" * n + "<p>y" * n + "</div>" * n
        assert "text, here" in html_text.main_text(page)
        return time.process_time() - began

    seconds(2_000)
    assert seconds(40_000) < 30 * seconds(4_000) + 0.5


def test_extract_minds_no_names_and_repeated_rows(spark):
    page = "<article><p>Some, text</p></article>"
    rows = [(1, "u", page, "a", "b"), (1, "u", page, "a", "b"), (None, None, None, None, None), (2, "v", "", "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, H string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "Some, text"), (1, "u", "Some, text"), (None, None, ""), (2, "v", "")], key=str)
