"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` gives the base counts of each text as expressions over arrays; ``THRESHOLDS`` names a
ratio of them and the range that a kept document lies in; ``judge`` compiles the table into one
boolean column.

Defined cases: a null or blank text has no words and fails the base rule; repeated rows and null ids
are kept; other columns are ignored; an empty table gives an empty result. Repeated windows are
found by sorting 64-bit hashes with their places, so very long texts stay n log n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: White space that separates words, and the symbols counted.
_SPACE, SYMBOLS = " \t\n\x0b\x0c\r", r"[#*$%&|<>]"
WINDOW = 5
#: Frequent function words of the languages handled.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an not "
    "de la le et les des en un du une que pour est dans qui par sur pas au avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y los se las del por con no su para al es lo"
).split()
#: (name, numerator, denominator, least, most, words): kept documents of at least so many words have
#: least <= ratio <= most; in shorter ones the ratio says too little.
THRESHOLDS = (
    ("word length", "word_chars", "n_words", 2.0, 14.0, 0),
    ("symbols", "n_symbols", "n_words", None, 0.25, 0),
    ("stop words", "n_stop_words", "n_words", 0.04, None, 50),
    ("repeated lines", "n_dup_lines", "n_lines", None, 0.5, 0),
    ("lines without lower case", "n_shouted_lines", "n_lines", None, 0.5, 0),
)
#: The base rule: fewest words, and most percent of words in repeated windows.
FEWEST, REPEATED = 10, 20


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _repeat_total(places: Column) -> Column:
    """Words covered by the windows that start at the sorted places."""
    last = F.size(places) - 1
    steps = F.transform(places, lambda v, j: F.when(j == last, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(places, j + 1) - v)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that thresholds are set on.

    Each step is a column of its own, which later steps read as a value: an expression inside a
    lambda would be evaluated again for every element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    a = a.select(
        "doc_id", "words", lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.size("words")
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    )
    a = a.select(
        "doc_id", "n_symbols", "lines", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"), grams.alias("grams"),
    )
    # only a text with some window twice pays for the sort
    sort = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), sort))
    same = F.filter(
        "sorted", lambda x, j: (F.get("sorted", j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get("sorted", j + 1)["h"] == x["h"]).eqNullSafe(True)
    )
    a = a.withColumn("places", F.sort_array(F.transform(same, lambda x: x["i"])))
    return a.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_total(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words", F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: (F.upper(x) == x) & (F.lower(x) != x))).cast("long").alias("n_shouted_lines"),
    )


def compiled(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one condition; a ratio over zero is within any bounds."""
    def rule(name, top, bottom, least, most, words):
        over, under = F.col(top).cast("double"), F.col(bottom).cast("double")
        tests = [over >= least * under] if least is not None else []
        tests += [over <= most * under] if most is not None else []
        return (F.col(bottom) == 0) | (F.col("n_words") < words) | reduce(Column.__and__, tests)

    return reduce(Column.__and__, [rule(*t) for t in thresholds], F.lit(True))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Counts, the base rule's failure and the verdict of every document."""
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"), "n_stop_words", "n_lines", "n_shouted_lines",
    )
