"""Classifiers on rows they never learned from, token digests against the library, near-duplicate links at the threshold, and pipeline edges."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import neardup, queries, toxicity

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@needs_tables
@pytest.mark.parametrize("query, label, threshold, positive", [(queries.op6_quality_model, "quality", 0.3, 1), (queries.op7_toxicity, "toxic", 0.5, 1)])
def test_models_on_held_out_rows(spark, query, label, threshold, positive):
    rows = {r.doc_id: r for r in query(spark, DATA).collect()}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == _held(i) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for i, r in rows.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r[label] is not None}
    held = [(rows[i].score, y) for i, y in truth.items() if i in rows and rows[i].held_out]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert auc > 0.9 and sum((s >= threshold) == bool(y) for s, y in held) / len(held) > 0.9


def test_without_labels_no_text_is_toxic(spark):
    docs = spark.createDataFrame([(1, "any text at all. and more"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.02 for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect())


def test_sentences_are_located(spark):
    model = toxicity.Model({zlib.crc32(b"wbad"): 9.0, zlib.crc32(b"wworse"): 12.0}, -6.0, -6.0)
    texts = ["Fine words. A bad one here. More! So worse.", "All fine. Really.", None, "", "bad. bad."]
    rows = toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()
    assert [(r.toxic_sentences, r.worst_sentence) for r in rows] == [([1, 3], 3), ([], 0), ([], None), ([], None), ([0, 1], 0)]
    assert rows[2].score == rows[3].score == 0.0 and rows[0].score > 0.99
    located = {(r.doc_id, r.sentence) for r in toxicity.offending_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert located == {(r.doc_id, k) for r in rows for k in r.toxic_sentences}


def test_bpe_digests(spark, tmp_path):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "don't  stop\n\nnow", "naïve 日本語 12345 \U0001f600", "<|endoftext|>", "x" * 3000, ("many words here, " * 4000) + "\t\n end", "a b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


@needs_tables
def test_no_link_of_the_table_is_missed(spark):
    """All links at 0.75 to 0.85 and above of a whole table, found by brute force over shared shingles."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rng = random.Random(3)
    bases = [[f"base{b}w{k}" for k in range(120)] for b in range(12)]
    for b, words in enumerate(bases):  # families with changed words, around the threshold
        for k in range(6):
            own = list(words)
            for place in rng.sample(range(120), k):
                own[place] = f"other{b}x{k}x{place}"
            docs[1_000_000 + 10 * b + k] = " ".join(own)
    sets, holders = {}, {}
    for i, t in docs.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in sets.items():
        shared = {}
        for s in own:
            for j in holders[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def _run_stages(spark, docs, folder):
    out, frame = [], docs
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, frame, folder).write.parquet(f"{folder}/edge{k}")
        frame = spark.read.parquet(f"{folder}/edge{k}")
        out.append(frame)
    return out


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    frames = _run_stages(spark, docs, str(tmp_path))
    assert all(f.count() == 0 for f in frames) and all(f.columns == corpus_pipeline.COLUMNS for f in frames[:-1])


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    body = " ".join(f"the word{k} of" for k in range(60))
    other = " ".join(f"and thing{k} to" for k in range(60))
    rows = [(1, body, None, None, None), (1, body, None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (None, other, "en", None, 5), (4, " \n ", None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("hub", "label", "score", "kept", "r1", "anchor", "spans", "x", "n", "ids"):
        docs = docs.withColumn(c, F.lit("clash"))
    frames = _run_stages(spark, docs, str(tmp_path))
    assert [f.count() for f in frames[:2]] == [6, 3] and all(f.columns == corpus_pipeline.COLUMNS for f in frames[:-1])
    assert {r.doc_id for r in frames[2].collect()} == {1, None} and {r.doc_id for r in frames[4].collect()} == {1, None}
