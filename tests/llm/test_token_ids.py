"""Packed ids are those of a freshly loaded tokenizer, and every id lies in exactly one piece."""

import collections
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from touchline.llm import packing

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y", "don't", "ABC", "é", "İ", "日本", "é", "\x1c", "Ñ12", "…", " ", "  ", "\n", " "]


def _texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def _fresh(text):
    return [*Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_ids_of_texts_with_special_strings():
    ids, fresh = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for text in _texts(3000):
        flat, bounds = ids.encode(pa.array([text]))
        assert flat.tolist() == [*fresh.encode(text, add_special_tokens=False).ids, packing.END_ID] and bounds.tolist() == [0, len(flat)]


def test_other_tokenizer_files_get_whole_texts(tmp_path):
    layout = json.load(open(WORDS, encoding="utf-8"))
    layout["normalizer"] = {"type": "Lowercase"}
    layout["added_tokens"][1]["lstrip"] = True
    (tmp_path / "own.json").write_text(json.dumps(layout), encoding="utf-8")
    ids, fresh = packing.WordIds(str(tmp_path / "own.json")), Tokenizer.from_file(str(tmp_path / "own.json"))
    assert not ids.by_word
    texts = _texts(200, 2)
    flat, bounds = ids.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*fresh.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_pieces_cover_every_id_once(spark):
    texts = dict(enumerate([*_texts(60, 3), None, "", "word " * 9000]))
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), WORDS, with_ids=False).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        whole, at = np.array(_fresh(text or ""), "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
