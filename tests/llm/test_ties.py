"""Nearest neighbours where more vectors tie than a search keeps."""

from touchline.llm import vptree


def test_ties_go_to_the_smaller_ids(spark):
    n = 300
    rows = [(1000 - i, [1.0, *(float(i == j) for j in range(n))]) for i in range(n)] + [(2000, [1.0] + [0.0] * n), (2001, [2.0] + [0.0] * n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r.rank, r.vec_id, r.score) for r in vptree.nearest(table, table.filter("vec_id = 2000"), 20).collect())
    assert got == [(1, 2001, 2.0)] + [(k + 2, 1001 - n + k, 1.0) for k in range(19)]
