"""The factorisation machine against the sum over all pairs, and its slopes against finite differences."""

import math

import numpy as np
import pyarrow as pa

from touchline.llm import quality_model as Q


def _model(seed=1):
    rng = np.random.default_rng(seed)
    return Q.Model(rng.normal(size=(Q.N_STATISTICS, Q.BINS - 1)).cumsum(axis=1), 0.3, rng.normal(0, 0.3, Q.N_FEATURES), rng.normal(0, 0.3, (Q.N_FEATURES, Q.RANK)))


def test_linear_time_score_is_the_sum_over_pairs():
    model, texts = _model(), ["a b c a", "", "one two\nthree!", "## x ## y", "w " * 60 + "end", None]
    row, feature, value = Q.Features().rows(pa.array(texts, pa.string()), model.edges)
    got, _ = Q.raw_scores(model, row, feature, value, len(texts))
    for d in range(len(texts)):
        own = [(int(f), float(x)) for r, f, x in zip(row, feature, value) if r == d]
        want = model.w0 + sum(model.w[f] * x for f, x in own)
        want += sum(float(model.v[f] @ model.v[g]) * x * z for i, (f, x) in enumerate(own) for g, z in own[i + 1 :])
        assert math.isclose(got[d], want, rel_tol=1e-9)


def test_slopes_by_finite_differences():
    model, texts, y = _model(2), ["a b c", "b c d\n!", "e"], np.array([1.0, 0.0, 1.0])
    row, feature, value = Q.Features().rows(pa.array(texts), model.edges)

    def loss(m):
        z, _ = Q.raw_scores(m, row, feature, value, 3)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g0, used, dw, dv = Q.slopes(model, row, feature, value, y)
    step = 1e-6
    for k, f in enumerate(used.tolist()):
        for array, at, want in [(model.w, f, dw[k]), *((model.v, (f, j), dv[k, j]) for j in range(Q.RANK))]:
            array[at] += step
            up = loss(model)
            array[at] -= 2 * step
            down = loss(model)
            array[at] += step
            assert math.isclose(want, (up - down) / (2 * step), rel_tol=1e-4, abs_tol=1e-8)
    up, down = (loss(Q.Model(model.edges, model.w0 + s, model.w, model.v)) for s in (step, -step))
    assert math.isclose(g0, (up - down) / (2 * step), rel_tol=1e-4)
