"""Quality rules as a short-circuit cascade.

Base measures are made for every text. The other rules form a cascade: on a bounded sample each rule's cost
(seconds a byte) and selectivity (share rejected) are measured, rules are ordered by rejection per cost, and a text
that one rule rejects is not shown to the next. The verdict is the conjunction of all rules, so it does not depend on
the measured order.

Null text counts as empty: no words, base_failed, not kept. Repeated rows are judged one by one. Columns other than
the id and text, whatever their names, are ignored by quality_measures and kept by quality_filter. A document is judged
whole, however long it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import text as X
from fathom.session import give_back, ship

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_STRIP = " \t\n\x0b\x0c\r"
#: Documented bound of the sample on which the cascade's order is estimated.
SAMPLE_ROWS = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Bytes of text that the filter works on at a time, unless a single text is longer.
FILTER_BLOCK = 4 << 20

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rule:
    """rejects(texts as UTF-8, base measures of these texts) -> bool for each."""

    name: str
    rejects: Callable[[list[bytes], dict[str, np.ndarray]], np.ndarray]


def _symbols(texts, m, most=0.1):
    return m["n_symbols"] > most * m["n_words"]


def _word_length(texts, m, least=2, most=20):
    return (m["word_chars"] < least * m["n_words"]) | (m["word_chars"] > most * m["n_words"])


def _dup_lines(texts, m, most=0.5):
    return m["n_dup_lines"] > most * np.array([t.count(b"\n") + 1 for t in texts])


def _shouting(texts, m, most=0.5):
    up = np.array([len(t) - len(t.translate(None, _UPPER)) for t in texts])
    low = np.array([len(t) - len(t.translate(None, _LOWER)) for t in texts])
    return up > most * (up + low)


def _exclaimed(texts, m, most=0.2):
    return np.array([t.count(b"!") for t in texts]) > most * m["n_words"]


def _wordless(texts, m, most=0.5):
    """Many words without a letter (bytes from 0x80 on count as letters)."""
    out = []
    for t, n in zip(texts, m["n_words"], strict=True):
        letters = sum(1 for w in t.split() if w.lower() != w.upper() or max(w) > 127)
        out.append(n - letters > most * n)
    return np.array(out, bool)


def _one_word(texts, m, most=0.3):
    out = []
    for t, n in zip(texts, m["n_words"], strict=True):
        seen: dict[bytes, int] = {}
        for w in t.split():
            seen[w] = seen.get(w, 0) + 1
        out.append(max(seen.values(), default=0) > most * n)
    return np.array(out, bool)


def _stuttering(texts, m, most=0.3):
    """Many words equal to the word before."""
    out = []
    for t, n in zip(texts, m["n_words"], strict=True):
        w = t.split()
        out.append(sum(map(bytes.__eq__, w, w[1:])) > most * n)
    return np.array(out, bool)


RULES = (
    Rule("wordless", _wordless),
    Rule("one_word", _one_word),
    Rule("stuttering", _stuttering),
    Rule("shouting", _shouting),
    Rule("exclaimed", _exclaimed),
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("dup_lines", _dup_lines),
)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Base measures of every text of an Arrow column."""
    data, offs = X.buffers(column)
    parts = [_measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in X.blocks(offs)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    s, e, first = X.word_bounds(data, offs)
    m = len(s)
    points = ~X.SPACE[data] & ((data & 0xC0) != 0x80)
    repeated = np.zeros(m, bool)
    at = X.gram_starts(first, 5)
    if len(at):
        h = X.gram_hashes(X.word_hashes(data, s, e), 5)[at]
        doc = np.searchsorted(first, at, "right").astype(np.uint64)
        key = h ^ X.mix(doc * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        repeated = X.covered(np.sort(at[order[same]]), 5, m)
    raw = data.tobytes()
    dup = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(first),
        "word_chars": X.per_text(points, offs),
        "n_symbols": X.per_text(_SYMBOL[data], offs),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": X.per_text(repeated, first),
    }


def base_failed(m: dict[str, np.ndarray], min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> np.ndarray:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_percent * m["n_words"])


def cascade(texts: list[bytes], m: dict[str, np.ndarray], alive: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """Runs the rules in turn, each on the texts that are still alive."""
    alive = alive.copy()
    for rule in rules:
        at = np.flatnonzero(alive)
        if not len(at):
            break
        bad = rule.rejects([texts[i] for i in at.tolist()], {k: v[at] for k, v in m.items()})
        alive[at[bad]] = False
    return alive


def order_rules(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(name, seconds a byte, share rejected) of each rule on a sample, best rejection per cost first."""
    m = measure(pa.array(texts, pa.binary()))
    ok = np.flatnonzero(~base_failed(m))
    texts, m = [texts[i] for i in ok.tolist()], {k: v[ok] for k, v in m.items()}
    size = max(1, sum(map(len, texts)))
    found = []
    for rule in rules:
        began = time.process_time()
        bad = rule.rejects(texts, m)
        cost = max(1e-12, (time.process_time() - began) / size)
        found.append((rule.name, cost, float(bad.mean()) if len(bad) else 0.0))
    # nothing rejected: cheap rules first
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def plan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[Rule, ...]:
    """The rules in the order that a sample of at most sample_rows texts suggests."""
    rows = docs.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).sample(0.25, seed).limit(sample_rows).collect()
    by_name = {r.name: r for r in rules}
    return tuple(by_name[n] for n, _, _ in order_rules([r.t.encode() for r in rows], rules))


def quality_measures(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """For each row: id, the base measures, base_failed, and kept (the cascade's verdict)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rules = plan(docs, text) if rules is None else rules
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1))
            data, offs = X.buffers(b.column(1))
            raw = data.tobytes()
            failed = base_failed(m)
            texts = [raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            kept = cascade(texts, m, ~failed, rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k], pa.int64()) for k in m), pa.array(failed), pa.array(kept)], names=[id, *m, "base_failed", "kept"])

    return docs.select(F.col(id), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, {SCHEMA}")


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that pass the base thresholds and every rule."""
    ship(docs.sparkSession)
    rules = plan(docs, text) if rules is None else rules
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in X.blocks(X.buffers(whole.column(at))[1], FILTER_BLOCK):
                b = whole.slice(i, j - i)
                m = measure(b.column(at))
                data, offs = X.buffers(b.column(at))
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield b.filter(pa.array(cascade(texts, m, ~base_failed(m), rules)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def sql(table: str = "documents", id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> str:
    """DuckDB SQL of quality_measures with RULES, on a table without repeated ids."""
    return rf"""
WITH d AS (SELECT {id} AS i, coalesce({text}, '') AS t, regexp_extract_all(coalesce({text}, ''), '[^ \t-\r]+') AS ws FROM {table}),
w AS (SELECT i, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
g AS (SELECT *, md5(string_agg(w, ' ') OVER (PARTITION BY i ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS h, lag(w) OVER (PARTITION BY i ORDER BY k) AS before FROM w),
f AS (SELECT i, k, w, before, k + 4 <= n AND count(*) FILTER (WHERE k + 4 <= n) OVER (PARTITION BY i, h) > 1 AS again FROM g),
c AS (SELECT i, w, before, coalesce(max(again::INTEGER) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS hit FROM f),
m AS (SELECT i, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words, count(*) FILTER (WHERE w = before) AS stutter,
    count(*) FILTER (WHERE regexp_matches(w, '[a-zA-Z]') OR strlen(w) > length(w)) AS lettered FROM c GROUP BY i),
o AS (SELECT i, max(n) AS one FROM (SELECT i, count(*) AS n FROM w GROUP BY i, w) GROUP BY i),
l AS (SELECT i, (count(*) - count(DISTINCT x)) AS n_dup_lines FROM (SELECT i, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t-\r]') GROUP BY i),
a AS (SELECT d.i, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, stutter, lettered, one, length(t) - length(replace(t, '!', '')) AS calls,
    length(t) - length(replace(t, chr(10), '')) + 1 AS lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low
    FROM d LEFT JOIN m USING (i) LEFT JOIN o USING (i) LEFT JOIN l USING (i)),
b AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_percent} * n_words AS base_failed FROM a)
SELECT i AS {id}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 2 * (n_words - lettered) > n_words OR one > 0.3::DOUBLE * n_words
    OR stutter > 0.3::DOUBLE * n_words OR 2 * up > up + low OR calls > 0.2::DOUBLE * n_words OR n_symbols > 0.1::DOUBLE * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > lines) AS kept FROM b"""
