"""Nearest neighbours against brute force over several shards and query blocks, without anything collected."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from touchline.llm import vptree


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def _expected(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = vptree.products(x[q][None], x)
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:k]
        out += [(int(ids[q]), r + 1, int(j), float(-v)) for r, (v, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8 << 20, 16_384), (16 << 10, 40)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vptree, "SHARD_BYTES", shard)
    monkeypatch.setattr(vptree, "QUERY_BLOCK", block)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 12)) * 2
    x = centres[rng.integers(0, 30, 3400)] + rng.normal(size=(3400, 12)) * rng.uniform(0.1, 1.5, (3400, 1))
    x[500:900] = x[500]  # a hot vector
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(3400), x)]
    table = _table(spark, rows)
    got = vptree.nearest(table, table.filter("vec_id % 20 = 0"))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == _expected(rows, 20)


def test_rows_that_repeat_an_id_are_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 256)
    rows = [(i, [float(i + 1), 1.0]) for i in range(60)] + [(7, [8.0, 1.0])] * 30 + [(9, [99.0, 1.0])] * 5
    got = [r.vec_id for r in vptree.nearest(_table(spark, rows), _table(spark, rows[:1]), 50).orderBy("rank").collect()]
    assert got == [i for i in range(59, 9, -1)]  # of the rows of id 9 the first in order counts


def test_nothing_but_counts_reaches_the_driver(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(200)]
    table = _table(spark, rows)
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("a table was collected"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table was collected"))
    monkeypatch.setattr(DataFrame, "first", lambda self, head=DataFrame.head: r if len(r := head(self)) == 1 else pytest.fail("more than a count"))
    monkeypatch.setattr(DataFrame, "head", lambda self, n=None: pytest.fail("rows were collected") if n and n > 1 else self.take(1)[0])
    monkeypatch.setattr(DataFrame, "take", lambda self, n: list(self.limit(n).toLocalIterator()))
    assert vptree.nearest(table, table.filter("vec_id % 20 = 0"), 3).count() == 30
