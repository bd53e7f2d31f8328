"""Operator 6: quality classifier, a factorisation machine.

A document is a sparse vector: hashed distinct words (scaled to unit length
together), one bucket of each structure statistic, and one bucket of its length.
Pairs of features interact through low-rank vectors, and the sum-of-squares
identity scores them in time linear in the features:
``0.5 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Fitting takes a bounded sample (``MAX_TRAIN_ROWS``); every text is scored whole,
in one pass without a shuffle, by a model of fixed size.

Defined results: a null text counts as empty, and an empty text is scored by its
structure alone; a null doc_id stays null; repeated rows give repeated results;
an empty table gives an empty result; without labels of both kinds every score
is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from touchline.llm.arrow import map_batches
from touchline.llm.training import MAX_TRAIN_CHARS, MAX_TRAIN_ROWS, training_sample

BITS, RANK, BINS = 16, 8, 12
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.05, 1e-5
THRESHOLD = 0.3
MEMO_WORDS = 400_000
WORD_BUCKETS = 1 << BITS

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>@^~_={}\\/", "mark": b".,;:", "shout": b"!?", "line": b"\n"}


@dataclass
class Model:
    edges: np.ndarray  # (statistics, BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray


def statistics_of(texts: pa.Array, codes: np.ndarray, n_words: np.ndarray, n_distinct: np.ndarray) -> np.ndarray:
    """(documents, statistics) of whole texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    size = np.diff(offsets)
    columns = [np.log1p(size)]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        places = np.flatnonzero(table[data[offsets[0] :]]) + offsets[0]
        columns.append(np.diff(np.searchsorted(places, offsets)) / np.maximum(size, 1))
    ends = np.cumsum(n_words)
    same = np.flatnonzero(np.concatenate([[False], codes[1:] == codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    columns.append(np.diff(np.searchsorted(same, np.concatenate([[0], ends]))) / np.maximum(n_words, 1))
    columns.append(n_distinct / np.maximum(n_words, 1))
    columns.append(size / np.maximum(n_words, 1))
    columns.append(np.log1p(n_words))
    return np.stack(columns, axis=1)


N_STATISTICS = len(_CLASSES) + 5
N_FEATURES = WORD_BUCKETS + N_STATISTICS * BINS


class Features:
    """Sparse rows of batches: (document, feature, value) sorted by document, and the statistics."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(texts))
        n_words = np.diff(words.offsets.to_numpy().astype(np.int64))
        coded = words.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        bucket = list(map(self.known.get, names))
        for k in [k for k, b in enumerate(bucket) if b is None]:
            bucket[k] = self.known[names[k]] = zlib.crc32(names[k].lower().encode()) & (WORD_BUCKETS - 1)
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        document = np.repeat(np.arange(len(texts)), n_words)
        pairs = np.unique(document * WORD_BUCKETS + (np.array(bucket, np.int64)[codes] if len(codes) else 0))
        return codes, n_words, pairs // WORD_BUCKETS, pairs % WORD_BUCKETS

    def rows(self, texts: pa.Array, edges: np.ndarray | None):
        texts = pc.fill_null(texts, "")
        codes, n_words, document, bucket = self.words(texts)
        n = np.bincount(document, minlength=len(texts))
        stats = statistics_of(texts, codes, n_words, n)
        if edges is None:
            return document, bucket, n, stats
        value = (1 / np.sqrt(np.maximum(n, 1)))[document]
        bins = np.stack([np.searchsorted(edges[j], stats[:, j], side="right") for j in range(stats.shape[1])], axis=1)
        bins += WORD_BUCKETS + np.arange(stats.shape[1]) * BINS
        row = np.concatenate([document, np.repeat(np.arange(len(texts)), stats.shape[1])])
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate([bucket, bins.ravel()])[order], np.concatenate([value, np.ones(bins.size)])[order]


def raw_scores(model: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits and the per-document sums that the gradient needs; linear in the features."""
    vx = model.v[feature] * value[:, None]
    starts = np.searchsorted(row, np.arange(n))
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    return model.w0 + np.add.reduceat(model.w[feature] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def slopes(model: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the mean log loss by w0, and by w and v of the features that occur (these come second)."""
    z, sums = raw_scores(model, row, feature, value, len(y))
    g = (1 / (1 + np.exp(-z)) - y) / len(y)
    used, place = np.unique(feature, return_inverse=True)
    each = (g[row] * value)[:, None] * (sums[row] - model.v[feature] * value[:, None])
    return float(g.sum()), used, np.bincount(place, g[row] * value, len(used)), np.stack([np.bincount(place, each[:, j], len(used)) for j in range(model.v.shape[1])], axis=1)


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(7)
    model = Model(np.zeros((N_STATISTICS, BINS - 1)), 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.01, (N_FEATURES, RANK)))
    y = np.array([v for _, v in sample], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(model.edges, 0.0, model.w, np.zeros_like(model.v))
    texts, features = pa.array([t for t, _ in sample], pa.string()), Features()
    stats = features.rows(texts, None)[3]
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    row, feature, value = features.rows(texts, model.edges)
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in own])
            r, f, x = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own]), feature[at], value[at]
            g, used, dw, dv = slopes(model, r, f, x, y[own])
            dw += DECAY * model.w[used]
            dv += DECAY * model.v[used]
            g0 += g**2
            gw[used] += dw**2
            gv[used] += dv**2
            model.w0 -= RATE * g / np.sqrt(g0)
            model.w[used] -= RATE * dw / np.sqrt(gw[used])
            model.v[used] -= RATE * dv / np.sqrt(gv[used])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    return fit(training_sample(docs, labels, label, max_rows, max_chars))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def step(batches):
        own, features = Model(*shared.value), Features()
        for batch in batches:
            texts = batch.column(1)
            z = raw_scores(own, *features.rows(texts, own.edges), len(texts))[0] if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, score double")
