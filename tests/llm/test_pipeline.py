"""The corpus pipeline against a plain Python version of its stages."""

import collections
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from touchline.llm import packing  # noqa: E402
from touchline.llm.quality_rules import STOP_WORDS  # noqa: E402


def _corpus():
    rng = random.Random(11)
    vocabulary = [f"lorem{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 300
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs, labels = [], []
    for i in range(240):
        text, toxic = "\n".join(sentence(rng.randint(12, 30)) for _ in range(6)), 0
        if i % 8 == 1:
            text, toxic = text.replace(".", " zblorg.", 1), 1
        elif i % 8 == 2:
            text += "\n" + passage + " " + sentence(5)
        elif i % 8 == 3 and i > 8:
            text = docs[i - 8][1] if docs[i - 8][2] == "base" else text
        elif i % 8 == 4:
            text = "short text"
        elif i % 8 == 5:
            text = " ".join(w + "###" for w in text.split())
        docs.append((i, text, "base" if i % 8 == 3 else "x", f"src{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    docs.append((500, None, None, None, None))
    docs.append((501, "", "en", "src0", 0))
    return docs, labels


def _expected(docs, labels):
    toxic = {i for i, _, t in labels if t}
    rows = [(i, t or "") for i, t, *_ in docs if i not in toxic]
    stops = {f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}

    def good(t):
        w = t.split()
        if len(w) < 50:
            return False
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = collections.Counter(grams)
        again = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        chars = sum(map(len, w))
        return 100 * len(again) <= 50 * len(w) and 2 <= chars / len(w) <= 14 and len(re.findall(r"[#*$%&|<>]", t)) / len(w) <= 0.4 and sum(x in stops for x in w) / len(w) >= 0.005

    rows = [(i, t) for i, t in rows if good(t)]
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        was = dict(label)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
        if was == label:
            break
    rows = [(i, t) for i, t in rows if label[i] == i]
    count = collections.Counter(tuple(t.split()[k : k + 35]) for _, t in rows for k in range(len(t.split()) - 34))
    out = {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = _corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    expected = _expected(docs, labels)
    assert 20 < len(expected) < 200 and any(t != docs[i][1] for i, t in expected.items())

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        step(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert frame.columns == corpus_pipeline.COLUMNS, name
    rows = {r.doc_id: r for r in frame.collect()}
    assert {i: r.text for i, r in rows.items()} == expected
    assert all(r.n_chars == len(r.text) for r in rows.values())

    ids = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[r.doc_id].append(r)
    assert set(packed) == set(expected)
    import numpy as np

    for i, pieces in packed.items():
        whole = np.array([*ids.encode(expected[i], add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
