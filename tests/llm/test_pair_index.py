"""Ids and decodings are those of a freshly loaded tokenizer, whatever the text."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from touchline.llm import pair_index

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y", "don't", "ABC", "é", "é", "İ", "日本", "\x1c", "Ñ12", "…", " ", "  ", "\n", "ß", "ǅ", "Σας", "'s", "'ll", "''d", "'re", "aaaa"]
PARTS += ["ﬁ", "١٢", "²¼", "힣", "하", "😀", "​", "\x85", "\xa0", "\xad", "a" * 50, "!?", "...", "--", "_", "ſ", "×÷µª"]


@pytest.fixture(scope="module")
def own():
    return pair_index.PairIndex(WORDS)


@pytest.fixture(scope="module")
def fresh():
    return Tokenizer.from_file(WORDS)


def _same(own, fresh, texts):
    for (ids, tokens), e, text in zip(own.encode([t.encode() for t in texts]), fresh.encode_batch(texts, add_special_tokens=False), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text[:200]
        assert bytes(tokens)[:-1].decode() == fresh.decode(e.ids, skip_special_tokens=False) == own.decode(np.array(e.ids, np.uint32)).decode()


def test_mixed_texts(own, fresh):
    rng = random.Random(1)
    _same(own, fresh, ["".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 14))) for _ in range(6000)])


def test_all_sorts_of_characters(own, fresh):
    rng = random.Random(2)
    marks = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x1FFFF, 13)]]
    _same(own, fresh, ["".join(rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(6000)])
    _same(own, fresh, ["".join(rng.choice("abcdeinthars") for _ in range(rng.randint(1, 40))) for _ in range(4000)])


@pytest.mark.parametrize("text", ["", " ", "\n", "<|endoftext|>", "'", "a'", "'such 'tis we'll 'llama 'r 'v ''s .'s 'é 's's s' 'RE"])
def test_short_texts(own, fresh, text):
    _same(own, fresh, [text])
    _same(own, fresh, ["", text, "", text])


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, " " * 2_000_000, "\t" * 100_000, "!" * 200_000, "7" * 100_000, "é" * 100_000, "x\n" * 100_000])
def test_long_runs(own, fresh, text):
    _same(own, fresh, [text, "end"])


def test_pairs_that_overlap_merge_from_the_left():
    vocabulary = {c: k for k, c in enumerate(["a", "b", "aa", "aaaa", "ab", "aab"])}
    merges = pair_index.Merges(vocabulary, [["a", "a"], ["aa", "aa"], ["a", "b"], ["aa", "b"]], "")
    assert merges.ascending
    for text, want in [("aaa", ["aa", "a"]), ("aaaaa", ["aaaa", "a"]), ("aaaaaaa", ["aaaa", "aa", "a"]), ("aab", ["aab"]), ("ab", ["ab"]), ("bab", ["b", "ab"])]:
        flat, bounds = merges.encode_runs(pa.array([text.encode(), text.encode()], pa.large_binary()))
        assert flat.tolist() == 2 * [vocabulary[t] for t in want] and bounds.tolist() == [0, len(want), 2 * len(want)]
    assert not pair_index.Merges(vocabulary, [["aa", "b"], ["a", "a"], ["aa", "aa"], ["a", "b"]], "").ascending  # a merge before its part


def test_documents_in_parts(spark, fresh, monkeypatch):
    monkeypatch.setattr(pair_index, "BLOCK_BYTES", 700)
    rng = random.Random(4)
    texts = [None, "", "  ", *("".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.choice([3, 40, 900]))) for _ in range(40)), "z" * 5000]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens").repartition(2)
    want = sorted((i is None, i or 0, tuple(fresh.encode(t or "", add_special_tokens=False).ids), fresh.decode(fresh.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)
    got = [tuple(r) for r in pair_index.encode_documents(docs, WORDS).collect()]
    assert sorted((i is None, i or 0, tuple(ids), text) for i, ids, n, text in got) == want and all(len(ids) == n for _, ids, n, _ in got)
    digests = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in pair_index.digest_documents(docs, WORDS).collect())
    assert digests == sorted((a, b, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for a, b, ids, text in want)
    assert pair_index.digest_documents(docs.limit(0), WORDS).count() == 0


def test_other_files_are_refused(tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        layout = json.load(f)
    for key, value in (("normalizer", {"type": "Lowercase"}), ("decoder", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})):
        (tmp_path / "own.json").write_text(json.dumps({**layout, key: value}), encoding="utf-8")
        with pytest.raises(ValueError):
            pair_index.PairIndex(str(tmp_path / "own.json"))
