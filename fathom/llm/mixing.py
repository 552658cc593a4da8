"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents form a tree domain -> language -> source. A token budget is handed down from the root: a node's budget is
divided among its children by weight, no child gets more than it can give (its tokens times max_epochs), and what a short
child leaves is divided among its siblings by weight, before anything goes back to the ancestors. As a node's limit is the
sum of its children's, one pass from the root downward does this exactly: among siblings in order of limit / weight, a
child is short if its limit is at most its share of what is left, and all others share the rest in proportion. Shares are
whole tokens, in exact arithmetic; what rounding down leaves goes to the first of these children, a token each. So the mix
has min(floor(share * all tokens), all limits) tokens.

A leaf with budget b and t tokens gives whole epochs, floor(b / t) of them, and a prefix of b mod t tokens of one more. In
each epoch documents stand in order of md5(seed/epoch/id). The prefix is found without ordering a leaf in one task:
running sums go over the first HEX hex digits first, and only documents of the digit group at the border are ordered.
The last document of a prefix is cut: `taken` says how many of its tokens belong to the mix.

Null domain, language or source is a group of its own. Null text has no tokens and is never taken. Rows that repeat an id
stand side by side, smaller ones first, and are taken one by one. Weights default to 1 and count to six digits after the
point; a node of weight 0 or less, or null or NaN, gives nothing. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.session import materialise, unused

HEX = 3
NULL = "\\N"


def n_tokens(text: Column | str) -> Column:
    """Words: runs outside space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column | str) -> Column:
    """A source's domain where a corpus has no such column: the last digit of its name, halved."""
    return F.concat(F.lit("d"), F.coalesce(F.floor(F.regexp_extract(source, r"(\d)$", 1).try_cast("int") / 2), F.lit(0)).cast("string"))


#: Weights are whole multiples of 1 / PARTS, up to MOST.
PARTS, MOST = 1_000_000, 1e9


def whole_weight(v: float | None) -> int:
    """A weight in PARTS; 0 for null, NaN and what is not above 0."""
    return 0 if v is None or not v > 0 else max(1, round(min(float(v), MOST) * PARTS))


def _weights(column: str, given: dict[str, float] | None) -> Column:
    if not given:
        return F.lit(PARTS).cast("long")
    table = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(whole_weight(v)).cast("long"))))
    return F.coalesce(table[F.col(column)], F.lit(PARTS).cast("long"))


def _times(a: str, b: str) -> Column:
    return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")


def divide(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `budget` to nodes(parent.., child, cap, w, total): total, the parent's budget, divided among siblings."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)), child)
    x = nodes.select(
        "*",
        F.row_number().over(order).alias("_n"),
        (F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_left"),
        F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("_w"),
    )
    x = x.withColumn("_short", _times("cap", "_w") <= _times("w", "_left"))
    x = x.withColumn("_first", F.min(F.when(~F.col("_short"), F.struct("_n", "_left", "_w"))).over(by))
    x = x.withColumn("_l", F.col("_first._left")).withColumn("_sum", F.col("_first._w")).withColumn("_product", _times("w", "_l"))
    x = x.withColumn("_share", F.when(~F.col("_short"), F.expr("_product div _sum")).otherwise(F.lit(0)))
    x = x.withColumn("_over", F.col("_l") - F.sum("_share").over(by))
    extra = F.when(F.col("_n") - F.col("_first._n") < F.col("_over"), 1).otherwise(0)
    x = x.withColumn("budget", F.when(F.col("_short"), F.col("cap")).otherwise(F.col("_share") + extra).cast("long"))
    return x.drop("_n", "_left", "_w", "_short", "_first", "_l", "_sum", "_product", "_share", "_over", "total", "cap", "w")


def budgets(leaves: DataFrame, total: int, max_epochs: int, domains: dict | None = None, langs: dict | None = None, sources: dict | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) of leaves(domain, lang, source, tokens)."""

    def limited(nodes: DataFrame, column: str, given: dict | None, cap: Column) -> DataFrame:
        return nodes.withColumn("w", _weights(column, given)).withColumn("cap", F.when(F.col("w") > 0, cap).otherwise(F.lit(0)).cast("long"))

    leaves = limited(leaves, "source", sources, F.col("tokens") * max_epochs)
    middle = limited(leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("_cap")), "lang", langs, F.col("_cap")).drop("_cap")
    top = limited(middle.groupBy("domain").agg(F.sum("cap").alias("_cap")), "domain", domains, F.col("_cap")).drop("_cap")
    top = divide(top.withColumn("total", F.lit(int(total)).cast("long")), [], "domain")
    middle = divide(middle.join(top.select("domain", F.col("budget").alias("total")), "domain"), ["domain"], "lang")
    low = leaves.join(middle.select("domain", "lang", F.col("budget").alias("total")), ["domain", "lang"])
    return divide(low, ["domain", "lang"], "source")


def select(docs: DataFrame, share: float, seed: int = 1, max_epochs: int = 3, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, domains: dict | None = None, langs: dict | None = None, sources: dict | None = None) -> DataFrame:
    """(id, domain, lang, source, epoch, tokens, taken): the mix of floor(share * all tokens) tokens, a row for each
    document and epoch it is taken in."""
    return _picks(docs, share, seed, max_epochs, id, text, lang, source, domain, domains, langs, sources)[0].drop("_key").withColumnRenamed("_id", id)


def _picks(docs: DataFrame, share: float, seed: int, max_epochs: int, id: str, text: str, lang: str, source: str, domain: Column | None, domains: dict | None, langs: dict | None, sources: dict | None) -> tuple[DataFrame, DataFrame]:
    """As select(), with _id for the id and _key, a hash of the text; and the stored table of documents it is made from."""
    domain = domain_of(source) if domain is None else domain
    group = [F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in (("domain", domain), ("lang", F.col(lang)), ("source", F.col(source)))]
    d = materialise(docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_key"), *group, n_tokens(text).alias("tokens")).where("tokens > 0"), "mix")
    leaf = ["domain", "lang", "source"]
    leaves = materialise(d.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = budgets(leaves, total, max_epochs, domains, langs, sources)
    plan = plan.select(*leaf, F.expr("budget div tokens").cast("long").alias("full"), F.expr("budget % tokens").alias("part"))
    plan = materialise(plan, "plan")

    x = d.join(plan, leaf)
    own = ["_id", "_key", *leaf]
    whole = x.where("full > 0").select(*own, F.explode(F.expr("sequence(0L, full - 1)")).alias("epoch"), "tokens", F.col("tokens").alias("taken"))
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(NULL))).cast("binary"))
    part = x.where("part > 0").withColumn("h", h).withColumn("p", F.substring("h", 1, HEX))
    sums = part.groupBy(*leaf, "p", "part").agg(F.sum("tokens").alias("t"))
    up = W.partitionBy(*leaf).orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("t").over(up) - F.col("t")).where("before < part").select(*leaf, "p", "t", "before")
    part = part.join(materialise(sums, "border"), [*leaf, "p"])
    inside = part.where("before + t <= part").select(*own, F.col("full").alias("epoch"), "tokens", F.col("tokens").alias("taken"))
    order = W.partitionBy(*leaf, "p").orderBy("h", "_id", "tokens", "_key").rowsBetween(W.unboundedPreceding, 0)
    edge = part.where("before + t > part").withColumn("before", F.col("before") + F.sum("tokens").over(order) - F.col("tokens")).where("before < part")
    edge = edge.select(*own, F.col("full").alias("epoch"), "tokens", F.least(F.col("tokens"), F.col("part") - F.col("before")).alias("taken"))
    return whole.union(inside).union(edge), d


def mix(docs: DataFrame, share: float, seed: int = 1, max_epochs: int = 3, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, domains: dict | None = None, langs: dict | None = None, sources: dict | None = None) -> DataFrame:
    """Rows of docs, all columns as they are, once for every epoch in which the mix takes the document (cut ones whole). Of
    rows with one id and text the mix has as many, however it came to them."""
    key, own, own_key, many, rows, k, n = unused(docs, "key", "own", "own_key", "many", "rows", "k", "n")
    picks, d = _picks(docs, share, seed, max_epochs, id, text, lang, source, domain, domains, langs, sources)
    picks = picks.groupBy("_id", "_key").agg(F.count("*").alias("_m"))
    # rows that are equal in id and text, of which there is seldom more than one
    again = d.groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_h")).agg(F.count("*").alias("_r")).where("_r > 1")
    picks = picks.join(again, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_h")), "left")
    picks = materialise(picks.select(F.col("_id").alias(own), F.col("_key").alias(own_key), F.col("_m").alias(many), F.coalesce("_r", F.lit(1)).alias(rows)), "picks")
    x = docs.withColumn(key, F.xxhash64(F.col(text).cast("string")))
    x = x.join(picks, F.col(id).eqNullSafe(F.col(own)) & (F.col(key) == F.col(own_key)))
    one = x.where(F.col(rows) == 1).withColumn(n, F.col(many))
    if not picks.where(F.col(rows) > 1).isEmpty():
        several = x.where(F.col(rows) > 1).withColumn(k, F.row_number().over(W.partitionBy(id, key).orderBy(F.lit(0))))
        one = one.unionByName(several.withColumn(n, F.floor(F.col(many) / F.col(rows)) + F.when(F.col(k) <= F.col(many) % F.col(rows), 1).otherwise(0)).drop(k))
    one = one.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    return one.select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL of select(documents, share, seed, max_epochs) with domain weights.
def sql(share: float, seed: int, max_epochs: int, domains: dict) -> str:
    weight = "CASE domain " + " ".join(f"WHEN '{k}' THEN {whole_weight(v)}" for k, v in domains.items()) + f" ELSE {PARTS} END::BIGINT"

    def split(name: str, table: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"{by} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE -1 END, {child}"
        return f"""
{name}_a AS (SELECT *, row_number() OVER ({order}) AS n, (total - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS l,
    sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ws FROM {table}),
{name}_b AS (SELECT *, cap * ws <= w * l AS short FROM {name}_a),
{name}_c AS (SELECT *, min_by(l, n) FILTER (WHERE NOT short) OVER ({by}) AS fl, min_by(ws, n) FILTER (WHERE NOT short) OVER ({by}) AS fw, min(n) FILTER (WHERE NOT short) OVER ({by}) AS fn FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN short THEN 0 ELSE (w * fl) // fw END AS part FROM {name}_c),
{name}_e AS (SELECT *, fl - sum(part) OVER ({by}) AS over_ FROM {name}_d),
{name} AS (SELECT * EXCLUDE (n, l, ws, short, fl, fw, fn, part, over_, total, cap, w), CASE WHEN short THEN cap ELSE part + CASE WHEN n - fn < over_ THEN 1 ELSE 0 END END::BIGINT AS budget FROM {name}_e)"""

    return f"""
WITH d AS (SELECT * FROM (SELECT doc_id, 'd' || coalesce(floor(TRY_CAST(regexp_extract(source, '([0-9])$', 1) AS INTEGER) / 2.0)::BIGINT, 0)::VARCHAR AS domain,
    coalesce(lang, '{NULL}') AS lang, coalesce(source, '{NULL}') AS source, len(regexp_extract_all(text, '[^ \\t-\\r]+'))::BIGINT AS tokens FROM documents) WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {max_epochs})::BIGINT AS cap FROM d GROUP BY ALL),
middle0 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
top0 AS (SELECT domain, CASE WHEN {weight} > 0 THEN sum(cap) ELSE 0 END::BIGINT AS cap, {weight} AS w, (SELECT floor(sum(tokens)::BIGINT * {share})::BIGINT FROM leaves) AS total FROM middle0 GROUP BY domain),
{split("top", "top0", "", "domain")},
middle1 AS (SELECT m.*, {PARTS}::BIGINT AS w, t.budget AS total FROM middle0 m JOIN top t USING (domain)),
{split("middle", "middle1", "domain", "lang")},
low0 AS (SELECT l.*, {PARTS}::BIGINT AS w, m.budget AS total FROM leaves l JOIN middle m USING (domain, lang)),
{split("low", "low0", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, budget // tokens AS full_, budget % tokens AS part FROM low),
x AS (SELECT d.*, full_, part FROM d JOIN plan USING (domain, lang, source)),
whole AS (SELECT doc_id, domain, lang, source, unnest(range(full_)) AS epoch, tokens, tokens AS taken FROM x WHERE full_ > 0),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}/' || full_::VARCHAR || '/' || doc_id::VARCHAR), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - tokens AS before FROM x WHERE part > 0)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, tokens, taken FROM whole
UNION ALL SELECT doc_id, domain, lang, source, full_::BIGINT, tokens, least(tokens, part - before)::BIGINT FROM run WHERE before < part"""
