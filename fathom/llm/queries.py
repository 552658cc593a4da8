"""The ten operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import html_text, line_dedup, mixing, packing, quality, simhash, sstable, substring, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(sstable.read(sstable.write(_table(spark, sf_dir, "documents"))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_measures(_table(spark, sf_dir, "documents"))


#: Production parameters of the mix: nine tenths of all tokens, at most three epochs, domains weighted 5 to 1.
MIX = {"share": 0.9, "seed": 1, "max_epochs": 3, "domains": {"d0": 5, "d1": 4, "d2": 3, "d3": 2, "d4": 1}}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(_table(spark, sf_dir, "documents"), **MIX)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_lines(_table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(substring.remove_repeats(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_token_tables, op4_quality, op5_mixing, op6_topk, op7_html, op8_line_dedup, op9_packing, op10_substring)
}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op4_quality": quality.sql(),
    "op5_mixing": mixing.sql(**MIX),
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, e, len(e) AS dim FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM c q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND q.dim = c.dim),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
t AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, t.top IS NOT NULL AND t.top <> l.doc_id AS gone FROM l LEFT JOIN t ON l.k = t.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op10_substring": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM
    (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM g WHERE i + 19 <= n),
m AS (SELECT w.doc_id, w.i, w.w, coalesce(max(f.again::INTEGER) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.i = f.i)
SELECT d.doc_id, count(m.i)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
}
