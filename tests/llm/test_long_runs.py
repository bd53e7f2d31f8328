"""Texts of one endless run crash nothing and have the ids of the ranks."""

import random

import pytest

from touchline.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoding():
    return bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("run", [" ", "\t", "\n", "\xa0", "　", " \n", "a", "!", "7", "é"])
@pytest.mark.parametrize("frame", ["{}", "x{}", "{}x", "one {}\n two", "{}!{} 12{}"])
def test_two_million(encoding, run, frame):
    text = frame.format(*[run * (2_000_000 // len(run))] * frame.count("{}"))
    ids = bpe.encode(encoding, text)
    assert encoding.decode_bytes(ids).decode() == text
    short = frame.format(*[run * 300] * frame.count("{}"))  # the ends of the long text have the ids of a short one's
    if len(run) == 1 and run.isspace():
        want = encoding.encode_ordinary(short)
        k = next((k for k, (a, b) in enumerate(zip(reversed(want), reversed(ids))) if a != b), len(want))
        assert k >= len(encoding.encode_ordinary(frame.rpartition("}")[2]))


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \t", "\n ", "\x85", "a", "."])
def test_as_the_library_does(encoding, run, monkeypatch):
    """With a low limit every run goes the other way, and the library can still do all of it."""
    monkeypatch.setattr(bpe, "RUN_CHARS", 3)
    monkeypatch.setattr(bpe, "_RUN", bpe.re.compile(f"[{bpe._SPACE}]{{3,}}"))
    monkeypatch.setattr(bpe, "PART_CHARS", 40)
    rng = random.Random(7)
    words = [run * 2, run * 3, run * 40, run * 5 + " ", "x", "don't", "12", " ", "\n", "\x1c", "é", "…", "!\x1c!", " ", "日本"]
    for _ in range(1500):
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        assert bpe.encode(encoding, text) == encoding.encode_ordinary(text), repr(text)


def test_documents(spark):
    texts = [" " * 1_200_000, "a" + "\n" * 1_500_000 + "b", None, "\t" * 60_000]
    rows = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == {i: t or "" for i, t in enumerate(texts)}
