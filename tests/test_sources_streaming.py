import pytest
from pyspark.sql import functions as F

from fathom.errors import FathomError
from fathom.operators import timeseries
from fathom.sources import text
from fathom.streaming import online


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,,x\n2, 3.5 ,4\n")
    rows = lambda **k: sorted(map(tuple, text.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "c"], **k).collect()))
    assert rows() == [(1.0, None, None), (2.0, 3.5, 4.0)]
    assert rows(lenient=True) == [(1.0, 0.0, 0.0), (2.0, 3.5, 4.0)]


def test_matrix_market_round_trip(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n2 2 2\n1 1 4.0\n2 1 -1.5\n")
    a = text.read_matrix_market(spark, str(tmp_path / "s.mtx"))
    want = [(1, 1, 4.0), (1, 2, -1.5), (2, 1, -1.5)]
    assert sorted(map(tuple, a.collect())) == want
    text.write_matrix_market(a, str(tmp_path / "out"))
    assert sorted(map(tuple, text.read_matrix_market(spark, str(tmp_path / "out")).collect())) == want


def test_dimacs_and_models(spark, tmp_path):
    (tmp_path / "f.cnf").write_text("c x\np cnf 3 2\n1 2 3 0\n-1 2 -3 0\n")
    c = text.read_dimacs(spark, str(tmp_path / "f.cnf"))
    assert c.count() == 6
    models = {r.model for r in text.sat_models(c, 3).collect()}
    assert models == {m for m in range(8) if (m & 7) and (not m & 1 or m & 2 or not m & 4)}
    assert text.sat_models(spark.createDataFrame([(0, 1, False), (1, 1, True)], "clause_id long, var long, negated boolean"), 1).count() == 0


def test_sdpa(spark, tmp_path):
    (tmp_path / "p.dat-s").write_text('"c\n2\n1\n2\n1.0 1.0\n0 1 1 1 1.0\n0 1 2 2 2.0\n1 1 1 1 1.0\n2 1 2 2 1.0\n')
    b, e = text.read_sdpa(spark, str(tmp_path / "p.dat-s"))
    assert b == [1.0, 1.0] and e.count() == 4
    (tmp_path / "q.dat-s").write_text("1\n2\n2 2\n1.0\n0 1 1 1 1.0\n")
    with pytest.raises(FathomError):
        text.read_sdpa(spark, str(tmp_path / "q.dat-s"))


def test_ema_stream_equals_table(spark, tmp_path):
    rows = [(f"k{i % 3}", f"2024-01-01 00:{i:02d}:00", i, float((i * 37) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, s string, i long, x double").select("k", F.to_timestamp("s").alias("ts"), "i", "x")
    order = [*range(0, 20), *range(25, 30), *range(20, 25), *range(30, 50)]
    for n, part in enumerate((order[:25], order[25:40], order[40:])):
        df.where(F.col("i").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a last row far ahead moves the watermark past all others
    spark.createDataFrame([("k9", "2024-01-02 00:00:00", 99, 0.0)], "k string, s string, i long, x double").select("k", F.to_timestamp("s").alias("ts"), "i", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.ema_stream(stream, "k", "ts", "i", "x", 0.3, "30 minutes").writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.tie: r.ema for r in spark.table("ema_out").collect()}
    want = {r.i: r.ema for r in timeseries.ema(df, "x", ["k"], ["i"], 0.3).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_session_windows(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:04:00"), ("a", "2024-01-01 01:00:00")], "u string, s string").select("u", F.to_timestamp("s").alias("ts"))
    assert sorted(r.n for r in online.sessions(df, "ts", ["u"], "5 minutes").collect()) == [1, 2]
    assert online.windowed_stats(df.withColumn("v", F.lit(1.0)), "ts", "v", ["u"], "5 minutes").count() == 2
