"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS, WORD_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from touchline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), with_ids=False)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.url_rules import apply_url_rules, rules_frame

    return apply_url_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark)).drop("url")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.quality_rules import apply_rules

    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    from touchline.llm.training import held_out

    own = [c for c in scores.columns if c not in ("doc_id", "score")]
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *own)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm import quality_model

    docs = table(spark, sf_dir, "documents")
    return _judged(quality_model.score_documents(docs, quality_model.train(docs, table(spark, sf_dir, "labels"))), quality_model.THRESHOLD)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.substrings import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm import vptree

    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter(F.col("vec_id") % vptree.EVERY == 0))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from touchline.llm.bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.turn_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op12_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from touchline.llm.pair_index import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_url_rules, op3_quality_rules, op4_main_text, op5_neardup, op6_quality_model, op7_toxicity, op8_substrings, op9_nearest, op10_bpe, op11_turn_trie, op12_pair_index, op13_whiten)}

_URL_PARTS = r"""
parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
"""

ORACLES = {
    "op2_url_rules": f"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
{_URL_PARTS},
fits AS (
  SELECT p.page_id, p.host, p.path, max(r.rhost || r.rpath) FILTER (WHERE true) AS any_rule,
    arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
""",
    "op3_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
starts AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM starts WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
    (length(body) - length(replace(body, '!!', ''))) // 2 AS n_exclaimed,
    len(list_filter(w, lambda x: list_contains(STOPS, x))) AS n_stop_words
  FROM base b LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0 OR n_symbols / n_words > 0.4 OR n_stop_words / n_words < 0.005
    OR coalesce(n_dup_lines / n_lines > 0.5, false) OR n_exclaimed / n_words > 0.5) AS kept
FROM judged
""",
    "op11_turn_trie": """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
  xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id),
whole AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) b ON b.conv_id = c.base),
steps AS (SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM whole),
paths AS (SELECT conv_id, depth, bytes, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends FROM ended GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, path)),
ups AS (SELECT t.*, unnest(range(0, t.depth + 1)) AS up FROM tree t),
folded AS (SELECT up AS depth, left(path, up * 64) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM ups GROUP BY ALL)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, f.n_leaves, f.saved_tokens, sha256(t.ends) AS ends_sha256
FROM tree t JOIN folded f USING (depth, path) LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.path = left(t.path, length(t.path) - 64)
""",
}


def _stops() -> str:
    from touchline.llm.quality_rules import STOP_WORDS

    return "[" + ", ".join(f"'{x}'" for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())) + "]"


ORACLES["op3_quality_rules"] = ORACLES["op3_quality_rules"].replace("STOPS", _stops())
