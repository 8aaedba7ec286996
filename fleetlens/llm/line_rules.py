"""Quality rules, line first.

Every line is judged on its own: navigation (a bar of short items), symbols tied to
words, shouting, boilerplate phrases, and missing punctuation in a long line.  Lines that
fail are removed; a document whose remaining lines hold too little of its text is
rejected.  Document statistics (words, symbols, repeated lines and repeated 3-word
windows) form the base verdict.  Everything is an expression over the row, so the
operator is one scan without a shuffle.

Words of a line are counted as those of the text, so a carriage return or a tab at either end
changes no verdict.  A text of any length is read whole.

Defined cases: a null, empty or blank text has no words and fails the base rules;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50  # share of words in repeated windows that is still allowed
LOST_PERCENT = 50  # share of characters that the line rules may remove

# fixed values: phrases of licence, cookie, account and navigation lines
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie policy", "we use cookies",
    "accept all cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "sign up for", "subscribe to our", "log in to", "click here to", "share on facebook", "follow us on",
    "back to top", "skip to content", "powered by",
)
SENTENCE_MARK = r"[.!?,;:…。！？،؟।]"
LONG_LINE = 12  # words from which a line must carry some punctuation


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the rules; a blank line never does."""
    words = _count(line, WORD)
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    shouts = _count(line, r"!!")
    low = F.lower(line)
    boiler = low.rlike("|".join(BOILERPLATE))
    return (
        ((bars >= 2) & (bars * 3 >= words))
        | ((symbols >= 3) & (symbols * 2 >= words))
        | ((shouts >= 3) & (shouts * 2 >= words))
        | boiler
        | ((words >= LONG_LINE) & ~line.rlike(SENTENCE_MARK))
    )


def judge_lines(docs: DataFrame) -> DataFrame:
    """Statistics, cleaned text and verdict of every document.

    Reads ``doc_id`` and ``text``.  Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_chars and
    clean_text (the text without its failed lines).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select(
        "*",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.split("_text", "\n").alias("_lines"),
    )
    word = lambda i: F.element_at(F.col("_words"), i)
    rows = rows.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.size("_words") < 3, F.array().cast("array<string>")).otherwise(
            F.zip_with(
                F.zip_with(F.col("_words"), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)),
                F.slice("_words", 3, F.greatest(F.size("_words") - 2, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b),
            )
        ).alias("_windows"),
        F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_full"),
    )
    # zip_with pads the tail with nulls: those two entries are no windows
    rows = rows.withColumn("_windows", F.slice("_windows", 1, F.greatest(F.size("_windows") - 2, F.lit(0))))
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    rows = rows.select(
        "*",
        # windows with their places in order of the words, so that equal ones are neighbours
        F.when(repeats, F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("_sorted"),
        F.size(F.filter("_full", line_fails)).alias("n_failed_lines"),
        F.filter("_full", lambda x: ~line_fails(x)).alias("_good"),
    )
    ordered = F.col("_sorted")
    last = F.size("_sorted")
    rows = rows.select(
        "*",
        F.array_sort(F.transform(
            F.filter(ordered, lambda x, k: F.coalesce(F.when(k > 0, F.get(ordered, k - 1)["w"] == x["w"]), F.lit(False))
                     | F.coalesce(F.when(k < last - 1, F.get(ordered, k + 1)["w"] == x["w"]), F.lit(False))),
            lambda x: x["i"],
        )).alias("_places"),
    )
    # a window covers three words, or as many as lie before the next repeated one
    gaps = F.zip_with(F.slice("_places", 2, F.greatest(F.size("_places") - 1, F.lit(1))), F.col("_places"), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(3)))
    length = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    rows = rows.select(
        "*",
        F.when(F.coalesce(F.size("_places"), F.lit(0)) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        length(F.col("_full")).alias("_all"),
        length(F.col("_good")).alias("_rest"),
    )
    rows = rows.select(
        "doc_id", "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.size("_full").cast("long").alias("n_lines"),
        F.col("n_failed_lines").cast("long").alias("n_failed_lines"),
        (F.col("_all") - F.col("_rest")).alias("lost_chars"),
        (100 * (F.col("_all") - F.col("_rest")) > LOST_PERCENT * F.col("_all")).alias("_lost"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("_lost")).drop("_lost")


_PHRASES = "|".join(BOILERPLATE)
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
    len(line) - len(replace(line, '|', '')) AS bars, len(line) - len(translate(line, '{SYMBOLS}', '')) AS sym,
    len(regexp_extract_all(line, '!!')) AS sh FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
v AS (SELECT *, (bars >= 2 AND bars * 3 >= nw) OR (sym >= 3 AND sym * 2 >= nw) OR (sh >= 3 AND sh * 2 >= nw)
    OR regexp_matches(lower(line), '{_PHRASES}') OR (nw >= {LONG_LINE} AND NOT regexp_matches(line, '[.!?,;:…。！？،؟।]')) AS fails FROM f),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(len(line)) AS whole, sum(CASE WHEN fails THEN len(line) ELSE 0 END) AS lost FROM v GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
  (len(text) - len(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(words)) AS base_failed,
  NOT (len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(words)) AND 100 * coalesce(lost, 0) <= {LOST_PERCENT} * coalesce(whole, 0) AS kept
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op7_line_rules", OP7_SQL)
def op7_line_rules(spark, sf_dir):
    return judge_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
