"""Whitening against the eigenvectors of a plain covariance."""

import math

import numpy as np
import pytest

from touchline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def _plain(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return e, centred @ u / np.sqrt(e), deviation, float((centred**2).sum() / n)


def _check(rows, ids, vectors, components):
    e, want, deviation, total = _plain(vectors)
    assert len(rows) == len(ids) * components
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    got = np.array([[found[i][k + 1].whitened for k in range(components)] for i in ids])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    for i, d in zip(ids, deviation):
        assert {(r.n, r.deviation) for r in found[i].values()} == {(len(ids), d)}
    for k in range(components):
        assert math.isclose(found[ids[0]][k + 1].explained, e[k] / total, rel_tol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


@pytest.mark.parametrize("d, components", [(40, 32), (3, 3)])
def test_whitened_rows(spark, d, components):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(500, d)) @ rng.normal(size=(d, d)) + 5).tolist()
    extra = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, []), (905, [1.0])]
    frame = spark.createDataFrame([*enumerate(vectors), *extra], SCHEMA).selectExpr("*", "1 AS n", "'x' AS component", "2 AS at").repartition(11)
    _check(whitening.whiten(frame).collect(), list(range(500)), vectors, components)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    source = table.toPandas()
    _check(whitening.whiten(table).collect(), source.vec_id.tolist(), source.embedding.tolist(), 32)


def test_directions_without_variance(spark):
    vectors = [[float(i), 2.0 * i, 1.0] for i in range(20)] + [[0.0, 0.0, 1.0]] * 2
    rows = whitening.whiten(spark.createDataFrame([(None if i == 3 else i, v) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(rows) == 3 * 22 and all(r.whitened == 0.0 and r.explained == 0.0 for r in rows if r.component > 1)
    assert math.isclose(rows[0].explained, 1.0) and rows[0].identity_error < 1e-12
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries(spark):
    """Entries beyond any count of steps crash nothing; deviations that no long holds are null."""
    frame = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 6 and any(r.deviation is None for r in rows) and all(math.isfinite(r.whitened) for r in rows)


def test_equally_frequent_lengths(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 5.0])], SCHEMA)).collect()
    assert {r.vec_id for r in rows} == {3, 4}


def test_factors_merge_in_any_number(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    want = np.abs(np.linalg.qr(x - x.mean(axis=0), mode="r"))
    for parts in (1, 2, 9, 70):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate((np.floor(x * 2**20) / 64).tolist())], "vec_id long, embedding array<double>").repartition(parts)
        vectors, d = whitening.prevailing(frame)
        n, sums = whitening.exact_sums(vectors, d)
        assert n == 400 and np.allclose(np.abs(whitening.factor_of(vectors, n, sums)) / 2**20, want, atol=1e-4)
