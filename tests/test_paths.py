"""The registered shortest paths run to their fixed point."""

from fathom import catalog


def test_sssp_finds_paths_of_more_than_three_edges(spark, monkeypatch):
    rows = [(3, 1, 1.0), (1, 2, 1.0), (2, 4, 1.0), (4, 5, 1.0), (3, 5, 9.0), (5, 6, 1.0), (7, 3, 1.0)]
    edges = spark.createDataFrame(rows, "src int, dst int, w double")
    monkeypatch.setattr(catalog, "_edges", lambda s, d: edges)
    got = {r.id: r.distance for r in catalog.QUERIES["sssp"](spark, "").collect()}
    assert got == {3: 0.0, 1: 1.0, 2: 2.0, 4: 3.0, 5: 4.0, 6: 5.0}
