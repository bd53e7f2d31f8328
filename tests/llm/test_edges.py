"""Every operator on nulls, empty, blank and long texts, repeated rows, an empty table and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from touchline.llm import bpe, neardup, packing, quality_model, quality_rules, substrings, toxicity, url_rules, vptree, wrappers

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
EXTRA = "key long, x long, hub long, label string, label_id int, anchor string, spans string, n long, a string, r1 long"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "a b c d", long, long, "x" * 50_000, "same words here " * 40, "same words here " * 40, "ÀÉ ß 日本 \x1c mixed"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    extra = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")]
    return base.select("*", *extra)


def test_bpe(docs):
    rows = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == 12
    texts = {(r.doc_id, (r.text or "").encode()) for r in docs.collect()}
    assert {(r.doc_id, bytes(r.decoded)) for r in rows} == texts
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_parts_are_safe():
    enc = bpe.load(RANKS, P.PATTERN)
    text = ("don't  stop\n\n now 12345 ¿qué?  " * 300) + "y" * 3000 + "   end"
    for size in (1, 7, 100, 2500):
        assert [i for part in bpe.safe_parts(text, size) for i in enc.encode_ordinary(part)] == enc.encode_ordinary(text)
        assert "".join(bpe.safe_parts(text, size)) == text


def test_packing(docs):
    rows = packing.pack_documents(docs, WORDS).collect()
    whole, seq = {}, {}
    for r in rows:
        assert len(r.ids) == r.length and r.length > 0
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for pieces in seq.values():
        at = 0
        for offset, length, size in sorted(pieces):
            assert offset == at
            at += length
        assert at == size and size & (size - 1) == 0
    for (_, tokens), pieces in whole.items():
        assert sum(n for _, n in pieces) % tokens == 0
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_quality_rules(docs):
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert rows[0].n_words == rows[1].n_words == rows[2].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[8].n_repeat_words == rows[8].n_words == 120 and rows[8].base_failed
    assert rows[None].n_words == 1
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_near_duplicates(docs, spark):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    assert len(rows) == 12
    got = {r[0]: r[1:] for r in rows}
    assert got[0] == (0, 0, True) and got[2] == (0, 2, True) and got[None] == (1, None, True)
    assert got[5][1] == got[6][1] == 5 and not got[6][2] and got[9][1] == 8
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [0, 1, 2, 4, 5, 7, 8, 10]


def test_substrings(docs):
    rows = sorted([(r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.removal_digests(docs).collect()])
    got = {r[0]: r[1:] for r in rows}
    assert got[1] == (0, 0) and got[5] == got[6] == (30_000, 30_000) and got[9] == (120, 120) and got[10][1] == 0
    assert substrings.removal_digests(docs.limit(0)).count() == 0
    assert substrings.without_repeats(docs).columns == docs.columns


def test_classifiers(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality_model, "quality")):
        model = module.train(docs, none, label)
        rows = module.score_documents(docs, model).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert module.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, toxicity.train(docs, none)).count() == 12


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "s://net/x", "http://b.org/fr/y", "http://network/x", "http://x..net/a"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(0, None, "h", "k")], "page_id long, url string, host string, key string")
    rows = url_rules.apply_url_rules(pages, url_rules.rules_frame(spark)).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 10 and got[0] == ("", "", None, "allow") and got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("example.net", "", None, "allow") and got[5][2:] == ("net/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][3] == "allow" and got[8][2] == "net/"
    assert url_rules.apply_url_rules(pages.limit(0), url_rules.rules_frame(spark)).count() == 0
    assert url_rules.apply_url_rules(pages, url_rules.rules_frame(spark).limit(0)).filter("verdict = 'allow'").count() == 10


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (2, "http://h/a", ""), (None, "http://h/b", "<p>a &amp; b<p>c"), (3, "http://h/c", "<body><nav><p>menu</nav><article><h1>T</h1><p>x <b>y</b><br>z" + " q" * 30_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, wrapper string")
    got = sorted((r.page_id or 0, r.n_chars, r.text[:9]) for r in wrappers.extract(pages).collect())
    assert got == [(0, 7, "a & b\nc"), (1, 0, ""), (2, 0, ""), (2, 0, ""), (3, 60_007, "T\nx y z q")]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (9, []), (10, [1.0, None]), (3, [1.0, 1.0]), (40, [0.0, 0.0])]
    t = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted(tuple(r) for r in vptree.nearest(t, t.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert vptree.nearest(t.limit(0), t.limit(0)).count() == 0
