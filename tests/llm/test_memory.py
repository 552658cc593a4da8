"""What a worker keeps after a task."""

from pyspark.sql import functions as F

from fathom.llm import packing, quality, tokens


def test_packing_leaves_an_empty_cache(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word some"), F.col("id")).alias("text")).coalesce(1)
    packing.pieces(docs)
    path = tokens.vocabulary("word_bpe_49k.json")

    def kept(batches):
        import pyarrow as pa

        for b in batches:
            held = [len(e.known) + len(e.known.old) for k, e in tokens._encoders.items() if k[0] == path]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["n"])

    # workers that have packed hold the entry of the empty segment only
    assert all(r.n <= 1 for r in spark.range(40).repartition(4).mapInArrow(kept, "n long").collect())


def test_filter_works_in_blocks(spark, monkeypatch):
    seen = []
    measure = quality.measure
    monkeypatch.setattr(quality, "measure", lambda c: seen.append(len(c)) or measure(c))
    monkeypatch.setattr(quality, "FILTER_BLOCK", 400)
    rows = [(i, "ten plain words stand here and %d more follow them now" % i if i % 3 else "!") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    class Taken:  # the filter's own function, called here
        columns, schema, sparkSession = docs.columns, docs.schema, spark

        def mapInArrow(self, f, schema):
            return list(f(iter(docs.toArrow().combine_chunks().to_batches())))

    got = quality.quality_filter(Taken(), rules=quality.RULES)
    assert max(seen) < 20 and sum(seen) == 50
    assert [i for b in got for i in b.column(0).to_pylist()] == [i for i, _ in rows if i % 3]
