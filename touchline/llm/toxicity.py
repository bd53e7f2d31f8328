"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a
logistic model over hashed words and word beginnings; a document's probability
is the noisy-or of its sentences and of one leak, which stands for all that is
not seen: one minus the product of their complements. A sentence counts with
what it has beyond a sentence without evidence, so clean sentences add nothing
and a text's length alone never makes it toxic. The model is fitted to document
labels alone, through the noisy-or, and then locates the sentences that make a
document toxic.

A sentence ends after a word with a closing mark, or at a line's end; it holds a
letter or digit at least, and marks that stand alone belong to the one before.

Fitting takes a bounded sample (``MAX_TRAIN_ROWS``); every text is scored whole,
in one pass without a shuffle, by a model of fixed size.

Defined results: a null or empty text, like every text without a sentence, has
the score 0; line ends and blanks, however many, are no words; a null doc_id
stays null; repeated rows give repeated results; an empty table gives
an empty result; without labels of both kinds no word counts and every text has
the fixed odds of ``BIAS``; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from touchline.llm.arrow import columns, map_batches
from touchline.llm.training import MAX_TRAIN_CHARS, MAX_TRAIN_ROWS, training_sample

PREFIXES = (4, 5, 6, 7, 8)
ROUNDS = 120
THRESHOLD = 0.5
MIN_EVIDENCE = 10.0
DECAY = 1e-4
BIAS = -6.0  # log odds of a sentence, and of the leak, before anything is learned
MOST_GROWTH = 0.25  # a clean text of 10,000 sentences has at most ten times the odds of a short one
FIRST_WEIGHT = 0.1  # what a feature with evidence begins with: sentences at the bias itself have no slope
MEMO_WORDS = 400_000
_SAID = re.compile(r"[^\W_]")  # a letter or digit
_LINE_END = "\x1d\x1e\x1d"  # stands for a line's end while words are split; a word of a text that is just this counts as one
_STRIP = ".,;:!?\"'()[]*#$%&|<>…«»¡¿"


def features_of(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    core = word.strip(_STRIP)
    if not core:
        return []
    data = [f"w{core}", *(f"{n}{core[:n]}" for n in PREFIXES if len(core) > n)]
    return [zlib.crc32(x.encode()) for x in data]


@dataclass
class Sentences:
    """The words of a batch of texts (but for marks that stand alone) and the sentences they form."""

    codes: np.ndarray  # of each word, its place in ``names``
    names: list[str]  # distinct words in lower case
    of_word: np.ndarray  # the sentence of each word
    document: np.ndarray  # of each sentence
    first_word: np.ndarray  # of each sentence: the place of its first word among all words of the text
    n_words: np.ndarray  # of each sentence, up to the next one or the text's end


def sentences_of(texts: pa.Array) -> Sentences:
    low = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {_LINE_END} "))
    words = pc.ascii_split_whitespace(low)
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    document = np.repeat(np.arange(len(texts)), np.diff(offsets))
    line_end = np.fromiter((w == _LINE_END for w in names), bool, len(names))[codes] if len(codes) else np.zeros(0, bool)
    shown = ~line_end & (np.fromiter((w != "" for w in names), bool, len(names))[codes] if len(codes) else line_end)  # splitting leaves empty words at white space at the ends
    n_shown = np.cumsum(shown)
    closed = np.fromiter((w[-1:] in (".", "!", "?", "…") or w == _LINE_END for w in names), bool, len(names))
    n_closed = np.cumsum(closed[codes]) if len(codes) else n_shown
    real = np.flatnonzero(shown & np.fromiter((_SAID.search(w) is not None for w in names), bool, len(names))[codes]) if len(codes) else np.zeros(0, np.int64)
    first = np.ones(len(real), bool)
    first[1:] = (document[real[1:]] != document[real[:-1]]) | (n_closed[real[1:] - 1] > n_closed[real[:-1]] - closed[codes[real[:-1]]])
    lead = real[first]
    before = np.append(0, n_shown)[offsets]  # shown words before each text, and in all
    place = n_shown[lead] - 1
    until = np.append(place[1:], 0)[: len(place)]
    last = np.append(document[lead[1:]] != document[lead[:-1]], True)[: len(lead)]
    until[last] = before[document[lead[last]] + 1]
    return Sentences(codes[real], names, np.cumsum(first) - 1, document[lead], place - before[document[lead]], until - place)


def evidence(in_1: np.ndarray, held: np.ndarray, n_1: float, n: int) -> np.ndarray:
    """Likelihood-ratio statistic of features that ``held`` documents hold, ``in_1`` of label 1; 0 where label 1 holds them less often."""
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda k, m, p: np.where(k > 0, k * np.log(k / (m * p)), 0.0)
        p, q = n_1 / n, 1 - n_1 / n
        out_1 = n_1 - in_1
        g = 2 * (term(in_1, held, p) + term(held - in_1, held, q) + term(out_1, n - held, p) + term(n - held - out_1, n - held, q))
    return np.where(in_1 > held * p, g, 0.0)


def softplus(x: np.ndarray | float) -> np.ndarray:
    return np.logaddexp(0, x)


def logistic(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def leaks(document: np.ndarray, n_docs: int, leak: float, growth: float) -> np.ndarray:
    """Log odds of the leak of each text: what is not seen grows a little with its sentences, by ``MOST_GROWTH`` of their logarithm at most."""
    return leak + growth * np.log1p(np.bincount(document, minlength=n_docs))


def document_scores(s: np.ndarray, document: np.ndarray, n_docs: int, bias: float, leak: float, growth: float = 0.0) -> np.ndarray:
    """The noisy-or of the leak and of what the sentences (log odds ``s``) have beyond one without evidence."""
    said = np.bincount(document, minlength=n_docs) > 0
    return np.where(said, -np.expm1(-softplus(leaks(document, n_docs, leak, growth)) - np.bincount(document, np.maximum(softplus(s) - softplus(bias), 0), n_docs)), 0.0)


def loss_and_slopes(s: np.ndarray, document: np.ndarray, y: np.ndarray, bias: float, leak: float, growth: float = 0.0) -> tuple[float, np.ndarray, float, float, float]:
    """Mean negative log likelihood, and its slopes by the evidence of each sentence, by the bias, by the leak and by its growth."""
    n = len(y)
    none = 1 - document_scores(s, document, n, bias, leak, growth)
    said = np.bincount(document, minlength=n) > 0  # texts without sentences teach nothing
    pull = said * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) / n
    by_s = pull[document] * logistic(s) * (s > bias)
    by_bias = by_s.sum() - (pull[document] * (s > bias)).sum() * logistic(bias)
    loss = -(said * np.where(y > 0, np.log(np.maximum(1 - none, 1e-300)), np.log(np.maximum(none, 1e-300)))).mean()
    by_leak = pull * logistic(leaks(document, n, leak, growth))
    return float(loss), by_s, float(by_bias), float(by_leak.sum()), float(by_leak @ np.log1p(np.bincount(document, minlength=n)))


class Adam:
    """Steps along a slope by its running mean and size."""

    def __init__(self, n: int, rate: float) -> None:
        self.rate, self.k, self.m, self.v = rate, 0, np.zeros(n), np.zeros(n)

    def step(self, slope: np.ndarray) -> np.ndarray:
        self.k += 1
        self.m = 0.9 * self.m + 0.1 * slope
        self.v = 0.999 * self.v + 0.001 * slope**2
        return self.rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.999**self.k)) + 1e-8)


@dataclass
class Model:
    weights: dict[int, float]  # by feature
    bias: float  # log odds of a sentence without evidence
    leak: float  # log odds of a text without sentences
    growth: float = 0.0  # of these odds with the logarithm of the sentences


def fit(sample: list[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """Feature weights, the sentence bias and the leak, by full-batch Adam on the noisy-or likelihood."""
    y = np.array([v for _, v in sample], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model({}, BIAS, BIAS)
    t = sentences_of(pa.array([t for t, _ in sample], pa.string()))
    codes, names, document = t.codes, t.names, t.document
    n_docs, flat, n_listed = len(y), array("I"), np.zeros(len(names), np.int64)
    for k, w in enumerate(names):
        own = features_of(w)
        flat.extend(own)
        n_listed[k] = len(own)
    bucket, word = np.frombuffer(flat, np.uint32), np.repeat(np.arange(len(names), dtype=np.int32), n_listed)
    # only features that sample documents of label 1 hold far more often may carry weight (a likelihood-ratio test), or rare words would memorise their documents
    begin, of_word = np.cumsum(n_listed) - n_listed, document[t.of_word].astype(np.int32)
    seen, place = np.unique(bucket, return_inverse=True)
    place = place.astype(np.int32)
    counts = np.zeros((2, len(seen)), np.int32)
    bounds = np.searchsorted(of_word, np.arange(n_docs + 1))
    for d in range(n_docs):
        own = np.unique(codes[bounds[d] : bounds[d + 1]])
        held = np.unique(np.concatenate([place[:0], *(place[begin[c] : begin[c] + n_listed[c]] for c in own)]))
        counts[int(y[d]), held] += 1
    strong = evidence(counts[1].astype(float), counts.sum(axis=0).astype(float), y.sum(), n_docs) >= MIN_EVIDENCE
    often = strong[place]
    del counts, seen, place
    word, bucket = word[often], bucket[often]
    used, place = np.unique(bucket, return_inverse=True)
    w, bias, leak, growth = np.full(len(used), FIRST_WEIGHT), BIAS, BIAS, 0.0
    steps = Adam(len(used), 0.1), Adam(1, 0.05), Adam(1, 0.05), Adam(1, 0.02)
    for _ in range(rounds):
        by_word = np.bincount(word, w[place], len(names))
        s = bias + np.bincount(t.of_word, by_word[codes], len(document))
        _, by_s, by_bias, by_leak, by_growth = loss_and_slopes(s, document, y, bias, leak, growth)
        g_word = np.bincount(codes, by_s[t.of_word], len(names))
        w -= steps[0].step(np.bincount(place, g_word[word], len(used)) + DECAY * w)
        bias -= float(steps[1].step(np.array([by_bias]))[0])
        leak -= float(steps[2].step(np.array([by_leak]))[0])
        growth = min(max(growth - float(steps[3].step(np.array([by_growth]))[0]), 0.0), MOST_GROWTH)
    return Model(dict(zip(used.tolist(), w.tolist())), bias, leak, growth)


class Scorer:
    """Sentence scores of batches; word weights are remembered between batches."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, Sentences]:
        """Log odds of all sentences."""
        t = sentences_of(texts)
        by_word = list(map(self.known.get, t.names))
        for k in [k for k, x in enumerate(by_word) if x is None]:
            by_word[k] = self.known[t.names[k]] = sum(self.model.weights.get(f, 0.0) for f in features_of(t.names[k]))
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        return self.model.bias + np.bincount(t.of_word, np.array(by_word, float)[t.codes] if len(t.codes) else None, len(t.document)), t

    def documents(self, texts: pa.Array) -> np.ndarray:
        s, t = self.sentences(texts)
        return document_scores(s, t.document, len(texts), self.model.bias, self.model.leak, self.model.growth)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    return fit(training_sample(docs, labels, label, max_rows, max_chars))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, toxic_sentences, worst_sentence`` of every row: the numbers of the sentences that reach the threshold, and of the likeliest one (null without sentences)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "toxic_sentences", "worst_sentence"]

    def step(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            s, t = scorer.sentences(batch.column(1))
            n, document = batch.num_rows, t.document
            score = document_scores(s, document, n, scorer.model.bias, scorer.model.leak, scorer.model.growth)
            first = np.searchsorted(document, np.arange(n))
            hit = np.flatnonzero(s >= np.log(threshold / (1 - threshold)))
            bounds = np.searchsorted(document[hit], np.arange(n + 1)).astype(np.int32)
            order = np.lexsort((-np.arange(len(s)), s, document))  # the last of each document is its likeliest sentence, the first of equals
            last = np.searchsorted(document, np.arange(n), side="right") - 1
            some = last >= first
            worst = np.where(some, order[np.maximum(last, 0)] - first if len(order) else 0, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(hit - first[document[hit]], pa.int64())), pa.array(worst, pa.int64(), mask=~some)], names
            )

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, score double, toxic_sentences array<long>, worst_sentence long")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def step(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.documents(batch.column(at)) < threshold))

    return map_batches(docs, step, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, sentence, first_word, n_words, probability`` of the sentences that reach the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "sentence", "first_word", "n_words", "probability"]

    def step(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            (ids,) = columns(batch, "doc_id")
            s, t = scorer.sentences(batch.column(1))
            lead = np.searchsorted(t.document, t.document)  # the first sentence of each one's document
            hit = np.flatnonzero(logistic(s) >= threshold)
            values = [[ids[d] for d in t.document[hit].tolist()], hit - lead[hit], t.first_word[hit], t.n_words[hit], logistic(s[hit])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] * 4 + [pa.float64()])], names)

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, sentence long, first_word long, n_words long, probability double")
