"""Sentences, noisy-or and slopes of the toxicity model against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import toxicity as T

WORDS = ["good", "bad", "end.", "Why?", "so", "...", "-", "!", "x", "«ja»", "¿qué?", "…", "a.b", "#1"]
GAPS = [" ", "  ", "\n", "\n\n \n", "\t", " "]


def plain(text):
    """(first word, words) of each sentence: they end after closing marks and lines, and hold a letter or digit."""
    words, out, open_ = [], [], False
    for line in (text or "").split("\n"):
        for w in line.split():
            if any(map(str.isalnum, w)) and not open_:
                out.append([len(words), 0])
                open_ = True
            words.append(w)
            if out:
                out[-1][1] += 1
            if w[-1] in ".!?…":
                open_ = False
        open_ = False
    return [tuple(s) for s in out]


def _texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " \n ", "...", *("".join(rng.choice(GAPS) + rng.choice(WORDS) for _ in range(rng.randint(0, 25))) + rng.choice(["", "\n", " "]) for _ in range(n))]


def test_sentences_as_a_plain_splitter():
    texts = _texts(800, 1)
    t = T.sentences_of(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for d, first, n in zip(t.document.tolist(), t.first_word.tolist(), t.n_words.tolist()):
        got[d].append((first, n))
    assert got == [plain(x) for x in texts]
    assert len(t.codes) == sum(any(map(str.isalnum, w)) for x in texts for w in (x or "").split())
    assert len(T.sentences_of(pa.array([], pa.string())).document) == 0


def _model(seed=2):
    rng = random.Random(seed)
    return T.Model({f: rng.uniform(-2, 4) for w in WORDS for f in T.features_of(w)}, -3.0, -4.0, 0.2)


def test_scores_are_the_noisy_or_of_leak_and_sentences():
    model, texts = _model(), _texts(300, 3)
    got = T.Scorer(model).documents(pa.array(texts, pa.string()))
    odds = lambda s: 1 / (1 + math.exp(-s))
    for text, score in zip(texts, got):
        words, none = (text or "").split(), 1 - odds(model.leak + model.growth * math.log1p(len(plain(text))))
        for first, n in plain(text):
            s = model.bias + sum(model.weights.get(f, 0.0) for w in words[first : first + n] if any(map(str.isalnum, w)) for f in T.features_of(w.lower()))
            none *= min(1.0, (1 - odds(s)) / (1 - odds(model.bias)))
        none = none if plain(text) else 1.0
        assert math.isclose(score, 1 - none, rel_tol=1e-9, abs_tol=1e-12)


def test_slopes_by_finite_differences():
    rng = np.random.default_rng(4)
    document, y = np.repeat(np.arange(20), 5), (np.arange(20) % 3 == 0).astype(float)
    x, bias, leak, growth, step = rng.normal(1, 2, 100), -1.5, -2.0, 0.1, 1e-6
    x[rng.random(100) < 0.2] = 0.0

    def loss(x, bias, leak, growth=growth):
        return T.loss_and_slopes(bias + x, document, y, bias, leak, growth)[0]

    _, by_s, by_bias, by_leak, by_growth = T.loss_and_slopes(bias + x, document, y, bias, leak, growth)
    for k in np.flatnonzero(x):
        d = np.zeros(100)
        d[k] = step
        assert math.isclose(by_s[k], (loss(x + d, bias, leak) - loss(x - d, bias, leak)) / (2 * step), rel_tol=1e-3, abs_tol=1e-8)
    assert math.isclose(by_bias, (loss(x, bias + step, leak) - loss(x, bias - step, leak)) / (2 * step), rel_tol=1e-3, abs_tol=1e-8)
    assert math.isclose(by_leak, (loss(x, bias, leak + step) - loss(x, bias, leak - step)) / (2 * step), rel_tol=1e-3, abs_tol=1e-8)
    assert math.isclose(by_growth, (loss(x, bias, leak, growth + step) - loss(x, bias, leak, growth - step)) / (2 * step), rel_tol=1e-3, abs_tol=1e-8)


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(5)
    clean = [" ".join(rng.choice(["bread", "river", "stone.", "green", "walks."]) for _ in range(40)) for _ in range(150)]
    toxic = [t + " you filthyword!" for t in clean[:50]]
    return T.fit([(t, 0) for t in clean[50:]] + [(t, 1) for t in toxic])


def test_length_and_lines_make_nothing_toxic(fitted):
    texts = ["bread river end", "bread river" + "\n" * 10_000 + "end", "bread. " * 1000, "river " + ". " * 5000, "bread\n" * 10_000, ""]
    scores = T.Scorer(fitted).documents(pa.array(texts))
    assert max(scores) < 0.05 and scores[1] == T.Scorer(fitted).documents(pa.array(["bread river\nend"]))[0]
    assert scores[3] == T.Scorer(fitted).documents(pa.array(["river"]))[0]
    assert T.Scorer(fitted).documents(pa.array(["bread\n" * 10_000 + "you filthyword!\n" + "bread\n" * 10_000]))[0] > 0.9


def test_located_among_lines(spark, fitted):
    text = "bread river.\n\n\n... green stone\nyou filthyword! - walks\n"
    rows = T.offending_sentences(spark.createDataFrame([(7, text)], "doc_id long, text string"), fitted).collect()
    assert [(r.doc_id, r.sentence, r.first_word, r.n_words) for r in rows] == [(7, 2, 5, 3)]
    assert text.split()[5:8] == ["you", "filthyword!", "-"]
    out = T.score_documents(spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string"), fitted).orderBy("doc_id").collect()
    assert (out[0].toxic_sentences, out[0].worst_sentence, out[1].toxic_sentences, out[1].worst_sentence) == ([2], 2, [], None)
