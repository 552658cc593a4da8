"""The pipeline's stages against plain versions on a small corpus."""

from collections import Counter

import pytest

import corpus_pipeline
from fathom.llm import line_dedup, mixing, quality

from .test_operators import brute_components, brute_fingerprint, corpus, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [r[:5] for r in corpus(150, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.quality_measures(docs).where("kept").collect()}
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    good = spark.createDataFrame(good.collect(), good.schema)
    cut = stages["line_dedup"](spark, good, sf_dir)
    assert cut.columns == docs.columns
    want = {r.doc_id: r.text for r in line_dedup.drop_lines(good).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())
    cut = spark.createDataFrame(cut.collect(), cut.schema)
    one = stages["near_dedup"](spark, cut, sf_dir)
    assert {r.doc_id for r in one.collect()} == set(brute_components({i: brute_fingerprint(t) for i, t in want.items()}).values())
    one = spark.createDataFrame(one.collect(), one.schema)
    mixed = stages["mixing"](spark, one, sf_dir)
    picks = Counter(r.doc_id for r in mixing.select(one, **corpus_pipeline.MIX).collect())
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == picks
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == picks
    assert all(len(words(want[r.doc_id])) > 0 for r in packed)
