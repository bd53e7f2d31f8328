"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty result; repeated rows are rows of their own, but for the
near-duplicate stage, where rows that repeat a doc_id are one document; null, empty, blank and very long texts are handled as
each stage says; other columns of the input, whatever their names, are left out. Nulls in lang, source and n_chars are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import neardup, packing, quality_rules, substrings, toxicity
from touchline.llm.staging import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_scratch: list[Stage] = []


def scratch(spark: SparkSession) -> Stage:
    """A folder for the tables between the steps of one stage; that of the stage before goes, as its result is written by now."""
    while _scratch:
        old = _scratch.pop()
        if old.spark is spark:
            old.remove()
    _scratch.append(Stage(spark))
    return _scratch[0]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score reaches the threshold go. The model is fitted on the labelled documents of the input.

    A null or empty text has no sentence, scores 0 and stays; so does a null doc_id with a clean text. Without labels nothing
    reaches the threshold. A score equal to the threshold goes."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the threshold table rejects go.

    A null, empty or blank text has no words and goes; a null doc_id decides nothing. A ratio equal to a limit stays."""
    return quality_rules.apply_rules(docs).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays.

    A similarity of exactly 0.75 links. Texts without words are linked with nothing and stay; a null doc_id is a group of its own."""
    return neardup.one_of_each(docs.select(*COLUMNS), scratch(spark))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeated windows go; every document stays, with what is left of its text and its length.

    A null text stays null with a null length; a text of fewer than 35 words stays as it is; repeated rows lose each other's windows."""
    kept = substrings.without_repeats(docs.select(*COLUMNS), scratch(spark))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null text is the empty one and has the end id only; a null doc_id stays null; each row is packed, repeated ones too."""
    import public_tokenizers

    scratch(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack),
]

ORACLE_SQL = None  # a fitted model, tokenizer ids and bin packing aren't SQL; tests/llm checks run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        before, docs = docs, stage.write(step(spark, docs, sf_dir))
        stage.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
