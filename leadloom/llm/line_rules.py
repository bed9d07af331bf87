"""Line-first quality rules as column expressions.

Every line of a text is judged by itself: punctuation (too many marks or shouting), navigation (a row of short
items between separators) and boilerplate (stock phrases of page furniture, a line seen before). Lines that
fail are removed; a document is rejected when the lines left hold too small a share of its words' characters,
or when it fails the base rules on length and repetition.

Null texts count as empty: no words, base rules failed, not kept. Rows that repeat are judged alike; columns of
the input other than the wanted id are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the word definition of the results: everything but space and tab to carriage return.
GAP = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
WINDOW = 3

#: Marks per hundred characters from which a line fails.
MARK_PERCENT = 10
MARKS = r"[#*$%&|<>=~^_{}\\!?]"
#: Items of a navigation row: at least so many separators, each with at most so many characters between.
SEPARATORS = 3
ITEM_CHARS = 25
SEPARATOR = r"[|»›·•]"
#: Stock phrases (lower case) of page furniture; a line fails if it holds one and is short.
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service",
    "terms of use", "subscribe to our newsletter", "sign up for", "log in", "click here", "share this",
    "follow us on", "skip to content", "javascript is disabled", "enable javascript", "lorem ipsum",
)
PHRASE_LINE_CHARS = 200
#: Percent of the words' characters that the lines left must hold.
LEAST_KEPT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def chars_of(line: Column) -> Column:
    """Characters of a line outside white space."""
    return F.length(F.regexp_replace(line, GAP, ""))


def punctuation_fails(line: Column) -> Column:
    return F.regexp_count(line, F.lit(MARKS)) * 100 >= F.length(line) * MARK_PERCENT


def navigation_fails(line: Column) -> Column:
    breaks = F.regexp_count(line, F.lit(SEPARATOR))
    return (breaks >= SEPARATORS) & (F.length(line) <= (breaks + 1) * ITEM_CHARS)


def boilerplate_fails(line: Column) -> Column:
    return (F.length(line) <= PHRASE_LINE_CHARS) & F.lower(line).rlike("|".join(PHRASES))


def line_fails(line: Column) -> Column:
    return punctuation_fails(line) | navigation_fails(line) | boilerplate_fails(line)


def _sorted_windows(hashes: Column) -> Column:
    """Windows sorted by (hash, place), so that equal ones stand together; empty, and not sorted, for a text
    that holds no window twice."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(placed)


def _covered(placed: Column) -> Column:
    """Distinct word places in the windows whose hash a neighbour shares."""
    again = F.filter(
        placed,
        lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]),
    )
    places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(places))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, line verdicts and the cleaned text of every document.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, clean_text.
    Windows are compared by a 64-bit hash of their words.
    """
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(
        id_col, "_text", words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    words, n = F.col("_words"), F.size("_words")
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    distinct = F.array_distinct("_lines")
    rows = rows.select(
        id_col, n.cast("long").alias("n_words"), F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(distinct)).cast("long").alias("n_dup_lines"),
        F.transform(starts, window).alias("_hashes"),
        # a line seen before fails as well: of equal lines the first is judged
        F.filter(distinct, lambda x: ~line_fails(x)).alias("_left"),
    )
    rows = rows.withColumn("_placed", _sorted_windows(F.col("_hashes"))).drop("_hashes")
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size("_placed") > 0, _covered(F.col("_placed"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.coalesce(chars_of(F.concat_ws("\n", "_left")), F.lit(0)).cast("long").alias("kept_chars"),
        F.concat_ws("\n", "_left").alias("clean_text"),
    )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured`` with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= LEAST_KEPT_PERCENT * F.col("word_chars")
    return measured(df, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)
