"""Repeated passages: every removal by the index, whatever tables are small and whatever anchors are hot."""

import collections
import hashlib
import random

import numpy as np
import pytest

from touchline.llm import substrings


def _expected(docs):
    words = [(i, (t or "").split()) for i, t in docs]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def _corpus():
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    passage, line, base = words(60), words(20), words(200)
    docs = [(i, words(30) + " " + (passage, line, words(50))[i % 3] + " " + words(25)) for i in range(90)]
    docs += [(100 + i, base) for i in range(40)] + [(200 + i, " ".join(w if rng.random() > 0.02 else "x" for w in base.split())) for i in range(40)]
    docs += [(300, "a b c " * 70), (301, "z " * 90), (302, None), (303, ""), (304, "z " * 34), (305, "y " * 35), (306, "y " * 35), (None, words(70))]
    return docs + [docs[-1]] * 3 + [(7, docs[7][1])]  # repeated rows


@pytest.mark.parametrize("hot, small, shard, run", [(600_000, 1_000_000, 300_000, 2048), (900, 1_000_000, 2000, 50), (900, 0, 300_000, 1), (0, 0, 500, 2048)])
def test_all_routes_give_the_same_exact_result(spark, monkeypatch, hot, small, shard, run):
    monkeypatch.setattr(substrings, "HOT_WORDS", hot)
    monkeypatch.setattr(substrings, "RUN_WINDOWS", run)
    monkeypatch.setattr(substrings, "SMALL_ROWS", small)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    docs = _corpus()
    got = substrings.removal_digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _expected(docs)
    if not small:  # beyond the bound the texts are joined by a shuffle, so no broadcast grows with the input
        assert "SortMergeJoin" in got._jdf.queryExecution().toString()


def test_ranges_that_touch_are_joined():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 60, rng.integers(1, 12))
        b = a + rng.integers(1, 15, len(a))
        covered = np.zeros(100, bool)
        for x, y in zip(a, b):
            covered[x:y] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        assert substrings.joined_ranges(a, b).tolist() == edge.tolist()
