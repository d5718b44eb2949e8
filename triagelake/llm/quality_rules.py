"""Quality rules: a table of thresholds compiled into one projection.

Measures of a text (length, symbols, stop words, lines, repetition) are Spark
expressions over its words and lines; a rule bounds a ratio of two of them; the
verdict is the conjunction of all rules.  No user function, no shuffle: the plan
is a scan with projections, whatever the size.

Words are runs of characters other than space and 0x09-0x0D.  Repetition is
found by hashing every window of eight words and sorting the hashes of a text
that has a repeated one.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; a null ``doc_id`` stays null; an empty table
gives no rows; other columns are passed through, but for those with the name of
a result, which replaces them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.columns import ROW, passed, whole_row

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # a power of two
MIN_WORDS = 20
MOST_REPEATED = 30  # percent

#: Frequent words of the languages accepted.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu "
    "au avec dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
)


class Rule(NamedTuple):
    """``low`` <= 100 * measure / per <= ``high``; None is no bound."""

    name: str
    measure: str
    per: str
    low: float | None
    high: float | None


RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("shouting", "n_marks", "n_words", None, 40),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("cut-off lines", "n_cut_lines", "n_lines", None, 50),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 90),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_marks", "n_lines", "n_cut_lines", "n_bullet_lines",
)
RESULTS = (*MEASURES, "base_failed", "kept")


def stop_word_forms() -> list[str]:
    """Each stop word, also capitalised, bare or before a comma or full stop."""
    words = sorted(set(STOP_WORDS.split()))
    return [f + end for w in words for f in (w, w.capitalize()) for end in ("", ",", ".")]


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once and written once in the plan.

    Spark copies an expression to wherever a filter above needs it; a chain of
    steps that each name the one before several times would grow without end.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(hashes: Column, width: int) -> Column:
    """Hashes of windows twice as wide, from those of ``width`` words."""
    left = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - width, F.lit(0)))
    right = F.slice(hashes, F.lit(width + 1), F.greatest(F.size(hashes), F.lit(1)))
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _windows(hashes: Column, width: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of the hashes of all windows of ``WINDOW`` words, by doubling."""
    if width == WINDOW:
        return body(hashes)
    return _let(_joined(hashes, width), lambda h: _windows(h, 2 * width, body))


def _repeated_starts(windows: Column) -> Column:
    """Ascending places of the windows that occur twice or more."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(sorted_: Column) -> Column:
        def place(s: Column, k: Column) -> Column:
            same = (F.get(sorted_, k - 1)["h"] == s["h"]) | (F.get(sorted_, k + 1)["h"] == s["h"])
            return F.when(same, s["i"])

        return F.array_sort(F.array_compact(F.transform(sorted_, place)))

    # sort only where some window repeats
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, _let(order, twice)).otherwise(F.array().cast("array<int>"))


def _covered(starts: Column) -> Column:
    """Words inside windows that start at these places."""

    def length(s: Column, k: Column) -> Column:
        return F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.transform(starts, length), zero, lambda a, n: a + n)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(
        hashes,
        lambda h: _windows(h, 1, lambda w: _let(_repeated_starts(w), _covered)),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``_doc``, and a column per measure."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    forms = stop_word_forms()
    base = docs.select(
        whole_row(),
        whole.alias("_text"),
        F.array_remove(F.split(whole, SPACE), "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    return base.select(
        ROW,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(forms))).cast("bigint").alias("n_stop_words"),
        _count_of(F.col("_text"), "!?").cast("bigint").alias("n_marks"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…")))
        .cast("bigint").alias("n_cut_lines"),
        F.size(F.filter("_lines", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•")))
        .cast("bigint").alias("n_bullet_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of a threshold table, as one expression over measures."""
    bounds = []
    for rule in rules:
        value, per = 100 * F.col(rule.measure), F.col(rule.per)
        if rule.low is not None:
            bounds.append(value >= F.lit(rule.low) * per)
        if rule.high is not None:
            bounds.append(value <= F.lit(rule.high) * per)
    return reduce(and_, bounds, F.lit(True))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with its measures, base_failed and kept."""
    failed = base_failed()
    return measure(docs).select(
        *passed(docs, RESULTS),
        *MEASURES,
        failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document of ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return judge_quality(docs.select("doc_id", "text")).select(
        "doc_id", *MEASURES[:5], "base_failed", "kept", *MEASURES[5:]
    )


def _sql_rules(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for rule in rules:
        value = f"100 * {rule.measure}"
        if rule.low is not None:
            parts.append(f"{value} >= {rule.low} * {rule.per}")
        if rule.high is not None:
            parts.append(f"{value} <= {rule.high} * {rule.per}")
    return " AND ".join(parts)


_FORMS_SQL = ", ".join(f"'{w}'" for w in stop_word_forms())
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
q AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM p),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM q),
o AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM n WHERE c > 1),
z AS (SELECT r, sum(least(coalesce(j - i, {WINDOW}), {WINDOW}))::BIGINT AS k FROM o GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(k, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_FORMS_SQL})))::BIGINT AS n_stop_words,
         (length(t) - length(translate(t, '!?', '')))::BIGINT AS n_marks,
         len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_cut_lines,
         len(list_filter(l, lambda x: prefix(x, '- ') OR prefix(x, '* ') OR prefix(x, '•')))::BIGINT
           AS n_bullet_lines
  FROM d LEFT JOIN z USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words
             AS base_failed FROM m)
SELECT *, NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
