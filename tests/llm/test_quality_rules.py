"""Quality rules against plain Python, and the shape of their plan."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from odd_tables import ROWS, empty, odd, prose
from pyspark.sql import functions as F

from triagelake.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [r[1] for r in ROWS] + [
    "a b c d e f g h " * 40,
    "one two three four five six seven eight",
    "x " * 9,
    prose(30, 8) + "\n" + prose(30, 9) + "\n" + prose(30, 8) + "\n \n\t\n" + prose(30, 8),
    " ".join(w + "###" for w in prose(60, 3).split()),
    " ".join(w.upper() + "!!" for w in prose(60, 3).split()),
    "• " + "\n• ".join([prose(9, k) for k in range(30)]),
    "a\x0bb\x0cc\rd\te\x1cf\xa0g　h",
]


def test_measures(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    rows = rules.judge_quality(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = measures(TEXTS[r.doc_id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == want, TEXTS[r.doc_id][:80] if TEXTS[r.doc_id] else None
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_verdict(spark):
    junk = [t for t in TEXTS[-8:-1] if measures(t)[0] >= 20]
    texts = [prose(200, k) for k in range(20)] + junk
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in rules.judge_quality(docs).filter("kept").collect()}
    assert kept >= set(range(20))
    dropped = [texts[k][:20] for k in range(20, len(texts)) if k not in kept]
    assert len(dropped) >= 4


def test_odd_rows_and_clashes(spark):
    out = rules.judge_quality(odd(spark))
    assert len(out.columns) == len(set(out.columns)) and {"_doc", "_text", "size"} <= set(out.columns)
    got = Counter((r.doc_id, r.n_words, r.word_chars) for r in out.collect())
    assert got == Counter((r[0], *measures(r[1])[:2]) for r in ROWS)
    assert rules.judge_quality(empty(spark)).count() == 0


def test_table_is_compiled(spark):
    table = (rules.Rule("all kept", "n_words", "n_words", 100, 100),)
    docs = spark.createDataFrame([(1, prose(50, 1)), (2, prose(5, 1))], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in rules.judge_quality(docs, table).collect()} == {1: True, 2: False}


def test_plan_has_no_shuffle_and_no_user_function(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = rules.judge_quality(docs.select("doc_id", F.col("text")))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Exchange", "Python", "Pandas", "ArrowEval"))
