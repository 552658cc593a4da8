"""A training corpus in five stages: quality rules, line dedup, near-duplicates, mix, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept. All but the last return
the columns of `documents`; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import line_dedup, mixing, packing, quality, shingles
from fathom.session import discard, materialise

#: Nine tenths of the tokens that reach the mix, domains weighted, two epochs at most: sources with little weight lose
#: documents, sources with much weight give some twice.
MIX = {"share": 0.9, "seed": 1, "max_epochs": 2, "domains": {"d0": 5, "d1": 4, "d2": 3, "d3": 2, "d4": 1}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, **MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Groups of near copies and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = materialise(out, name)
            discard(docs)  # what the stage before wrote
        docs = out
    return docs
