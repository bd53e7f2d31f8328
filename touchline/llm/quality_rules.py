"""Operator 3: document quality rules as one Spark projection.

A threshold table (``RULES``) is compiled into columns of a single ``select``:
lengths, symbol, stop-word, repetition and line ratios. Nothing is shuffled and
no user function runs; all of it is built-in expressions over one row.

Repeated three-word windows are found by sorting the window hashes of a text, so
a text of n words costs n log n, also if every window repeats.

Defined results: a null text has no words (all counts 0, ``base_failed``); a null
doc_id stays null; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages (fixed values of this operator).
STOP_WORDS = (
    "the of and to a in is that for it was on are as with by be this at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du est que dans pour qui sur par pas au avec "
    "el los las y del se por con una su para es al lo como más o"
).split()

# name, numerator and denominator among the measures, side and limit on which a text fails
RULES = (
    ("mean_word_length_low", "word_chars", "n_words", "<", 2.0),
    ("mean_word_length_high", "word_chars", "n_words", ">", 14.0),
    ("symbol_ratio", "n_symbols", "n_words", ">", 0.4),
    ("stop_word_ratio", "n_stop_words", "n_words", "<", 0.005),
    ("dup_line_ratio", "n_dup_lines", "n_lines", ">", 0.5),
    ("exclaimed_word_ratio", "n_exclaimed", "n_words", ">", 0.5),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, whatever uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    even = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(even == "", F.array().cast("array<string>")).otherwise(F.split(even, " +"))


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice, its first place included.

    ``starts`` holds the places of such windows in order; each adds the words it does not share with the next one."""

    def starts(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def repeated(s: Column) -> Column:
            last = F.size(s) - 1
            at = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(at, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<int>")).otherwise(_let(F.sort_array(placed), repeated))

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda x, k: F.when(k == F.size(s) - 1, 3).otherwise(F.least(F.lit(3), F.get(s, k + 1) - x)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = _let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(_let(_let(windows, starts), covered))


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the columns of ``MEASURES`` added (they replace columns of the same names)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stop = [form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())]
    out = docs.withColumn("__words", words_of(F.col(text))).withColumn("__lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": repeat_words(F.col("__words")),
            "n_stop_words": F.size(F.filter("__words", lambda w: w.isin(stop))).cast("bigint"),
            "n_exclaimed": ((F.length(body) - F.length(F.replace(body, F.lit("!!"), F.lit("")))) / 2).cast("bigint"),
        }
    ).drop("__words", "__lines")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclaimed"]


def verdict(rules=RULES) -> Column:
    """True where no rule fails; a ratio over zero is null and fails no rule."""
    fails = [F.coalesce(F.expr(f"try_divide({part}, {whole}) {side} {limit}D"), F.lit(False)) for _, part, whole, side, limit in rules]
    return ~reduce(lambda a, b: a | b, fails)


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The input with the measures, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
