"""License scans against plain Python over all blocks of all texts."""

from __future__ import annotations

import random
import re
from collections import Counter

from odd_tables import ROWS, empty, odd, prose

from triagelake.llm import license_scans as scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(text, templates=scans.TEMPLATES):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in scans.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                base.add(label)
    labels, best = set(base), 1.0 if places else 0.0
    for t in templates:
        m, tokens = len(t.words), set(t.tokens)
        for start in range(0, max(len(words), 1), m):
            common = len(tokens & set(words[start : start + 2 * m]))
            if common >= t.need:
                labels.add(t.label)
                best = max(best, common / len(tokens))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), best,
    )


def check(spark, rows, templates=scans.TEMPLATES):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(map(tuple, scans.scan_licenses(docs, templates).collect()))
    assert got == Counter((i, *expected(t, templates)) for i, t in rows)
    return got


def test_odd_rows_and_phrases(spark):
    lines = [
        "All rights reserved. ALL  RIGHTS\nReserved, all rights; reserved",
        "Licensed under CC BY-NC 4.0.", "cc cc by by CC-BY", "general public general public license",
        "Released under the MIT License.", "mit der Lizenz und license", "Apache License, 2.0 Version",
        "rights all reserved", "ALL RIGHTS RESERVED " * 4000,
        "permission is hereby granted, free of charge " * 2000,
    ]
    rows = [(r[0], r[1]) for r in ROWS] + list(enumerate(lines, 100))
    got = check(spark, rows)
    assert any(k[0] == 104 and k[6] == "mit" for k in got)
    assert any(k[0] == 106 and k[6] == "apache-2.0" for k in got)


def test_notices_with_edits_at_any_place(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        t = rng.choice(scans.TEMPLATES)
        words = t.notice.split()
        for _ in range(rng.randint(0, len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "license"])
        if rng.random() < 0.2:
            rng.shuffle(words)
        text = prose(rng.randint(0, 90), k) + "\n" + " ".join(words) + ", " + prose(rng.randint(0, 60), k + 1)
        rows.append((k, text))
    got = check(spark, rows)
    assert sum(k[6] != "" for k in got) > 60


def test_templates_that_share_frequent_words(spark):
    templates = [
        scans.Template("x", "a b c d e f", 0.5), scans.Template("y", "c d e", 1.0),
        scans.Template("x", "a a a b", 1.0), scans.Template("z", "f e d c b a z", 0.8),
    ]
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 40)))) for k in range(200)]
    check(spark, rows, templates)


def test_clashing_names_empty_table_and_repeats(spark):
    got = scans.scan_licenses(odd(spark))
    assert got.count() == len(ROWS) and got.columns[0] == "doc_id" and len(got.columns) == 8
    assert scans.scan_licenses(empty(spark)).count() == 0
    check(spark, [(1, "MIT License. cc by"), (1, "MIT License. cc by"), (None, None), (None, None), (1, "x")] * 3)


def test_plan_is_native_with_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = scans.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
    assert plan.count("Exchange hashpartitioning") == 1
