"""Operators against plain Python on small inputs."""

import collections
import random

import numpy as np
import pytest

from touchline.llm import fmindex, neardup, packing, substrings, toxicity, vptree, wrappers


def _documents(seed=3, n=160):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 160))] for _ in range(12)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        else:
            words = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(vocabulary) for w in rng.choice(bases)]
        out.append((i, " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return out


def test_near_duplicates_are_whole(spark):
    docs = _documents()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i, _ in docs}
    for _ in range(len(docs)):
        before = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = min(label[i], label[j])
        if before == label:
            break
    assert got == label


@pytest.mark.parametrize("hot", [600_000, 5])
def test_repeats_are_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_WORDS", hot)
    docs = [(i, t + " " + t[: 40 * (i % 3)]) for i, t in _documents(5, 60)] + [(100, "p q " * 60), (101, "z " * 90)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    import hashlib

    words = {i: t.split() for i, t in docs}
    count = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_fm_index_finds_all_repeated_windows():
    rng = np.random.default_rng(2)
    for trial in range(30):
        width, symbols = int(rng.integers(2, 36)), int(rng.integers(1, 20))
        base = rng.integers(1, symbols + 1, 200)
        rows = set()
        for _ in range(15):
            a = int(rng.integers(0, 60))
            row = base[a : a + width + int(rng.integers(0, 100))].copy()
            row[rng.random(len(row)) < 0.02] = 1
            rows.add(tuple(row.tolist()))
        rows = [r for r in rows if len(r) >= width]
        text = np.array([s for r in rows for s in (*r, 0)])
        starts = np.cumsum([0, *(len(r) + 1 for r in rows)])[:-1]
        windows = np.array([len(r) - width + 1 for r in rows])
        count = collections.Counter(r[k : k + width] for r in rows for k in range(len(r) - width + 1))
        expected = {(i, k) for i, r in enumerate(rows) for k in range(len(r) - width + 1) if count[r[k : k + width]] > 1}
        found = fmindex.repeated_windows(fmindex.FMIndex(text), text, starts, windows, width)
        assert {(int(s), k) for s, a, b in zip(*found) for k in range(a, b + 1)} == expected, trial


def test_tree_is_exact_with_factor_one():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) * rng.uniform(0.2, 3, (3000, 1))
    q = rng.normal(size=(40, 8))
    rows, best = vptree.Tree(x).search(q, 10)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert all(set(a) == set(b) for a, b in zip(rows.tolist(), exact.tolist()))
    assert np.allclose(np.sort(best, axis=1)[:, ::-1], -np.sort(-(q @ x.T), axis=1)[:, :10])
    wide = vptree.Tree(x).search(q, 10, factor=3.0)[0]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(wide.tolist(), exact.tolist())]) > 0.5


def test_blocks_are_full_and_whole():
    rng = random.Random(1)
    for n in (1, 3, 50, 400):
        lengths = [rng.choice([1, 5, 300, 900, 4096, 4097, 9000]) for _ in range(n)]
        windows = list(packing.pack_block(lengths))
        assert sum(s for s, _ in windows) == sum(lengths)
        seen = collections.defaultdict(list)
        for size, pieces in windows:
            assert size & (size - 1) == 0 and sum(p[2] for p in pieces) == size
            for i, start, k in pieces:
                seen[i].append((start, k))
        for i, length in enumerate(lengths):
            at = 0
            for start, k in sorted(seen[i]):
                assert start == at
                at += k
            assert at == length
        groups = packing.step_groups(windows)
        assert len(groups) == len(windows)


def test_toxic_sentences_are_found(spark):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(300):
        s = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            s[i % 5] += " grumbolt"
        rows.append((i, ". ".join(s) + ".", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in rows)
    hits = toxicity.offending_sentences(docs, model).collect()
    assert {(h.doc_id, h.sentence) for h in hits} == {(i, i % 5) for i, _, y in rows if y}


def test_wrapper_drops_labelled_constants_and_keeps_text():
    page = "<html><body><header><h1>Site</h1></header><div class='menu-x'><a href=1>{a}</a></div><div class='c1'><h1>{t}</h1><div class='k9'>Always the same line</div><p>{b}</p><ul><li>{a}<li>two</ul><form><p>no</p></form><div class='comments'><p>{t}</p></div></div><footer>f {a}</footer></body></html>"
    pages = [page.format(a=f"a{i}", t=f"title number {i}", b=f"body text of the page number {i} &lt;tag&gt; &amp; more") for i in range(5)]
    import json

    wrapper = wrappers.induce(pages)
    assert wrapper["path"][-1] == "div.c1"
    text = wrappers.main_text(pages[3], json.dumps(wrapper))
    assert text == "title number 3\nbody text of the page number 3 <tag> & more\na3\ntwo"


def test_word_hashes_fold_only_ascii(spark):
    import pyarrow as pa

    from touchline.llm.shingles import shingle_sets

    flat, bounds = shingle_sets(pa.array(["A B c", "a b C", "É", "é", "", None]))
    parts = [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert parts[0] == parts[1] and parts[2] != parts[3] and parts[4] == parts[5] == []
