"""One row of each group stays where ids repeat or are null."""

from fathom.llm import shingles, simhash

X, Y, Z = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"


def test_one_row_of_each_group_where_ids_repeat(spark):
    rows = [(5, X), (5, Y), (3, Y), (2, Z), (2, Z), (7, Z), (None, Z), (None, "alone in its group")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keep in (simhash.keep_one, shingles.keep_one):
        got = sorted(((r.doc_id, r.text) for r in keep(docs).collect()), key=str)
        assert got == sorted([(5, X), (3, Y), (2, Z), (None, "alone in its group")], key=str)


def test_columns_with_the_names_of_helpers(spark):
    rows = [(1, X, 7, 8), (1, X, 7, 8), (2, Y, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int, _T int")
    got = shingles.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, X, 7, 8), (2, Y, 7, 8)]
