"""Mixing: targets by water filling, words taken, positions against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from odd_tables import ROWS, empty, odd, prose
from pyspark.sql import functions as F

from triagelake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sized(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return docs.withColumn("size", mixing.words(F.col("text")))


def targets(sizes):
    """Water filling, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_, found = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return found | {s: left * weight[s] / total for s in open_}
        for s in over:
            found[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return found


def check(rows, texts):
    sizes = Counter()
    for _, text, _, source in texts:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = targets(sizes), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1


def test_odd_rows(spark):
    docs = odd(spark, clashes=False).withColumn("size", mixing.words(F.col("text")))
    check(mixing.mix_documents(docs).collect(), ROWS)


def test_clashing_columns_pass(spark):
    docs = odd(spark).drop("size").withColumn("size", mixing.words(F.col("text")))
    out = mixing.mix_documents(docs)
    assert set(docs.columns) | set(mixing.RESULTS) == set(out.columns)
    assert len(out.columns) == len(set(out.columns)) and out.count() == len(ROWS)


def test_empty(spark):
    docs = empty(spark).drop("size").withColumn("size", mixing.words(F.col("text")))
    assert mixing.mix_documents(docs).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_no_words_at_all(spark):
    rows = [(1, "", "en", "a"), (2, None, "en", None)]
    out = mixing.mix_documents(sized(spark, rows)).collect()
    assert [(r.target, r.taken, r.passes) for r in out] == [(0.0, 0, [])] * 2


def test_hot_source_and_positions(spark):
    rows = [(i, prose(10 + i % 40, i), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    mixed = mixing.mix_documents(sized(spark, rows))
    out = mixed.collect()
    check(out, rows)
    again = mixing.mix_documents(sized(spark, rows).repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken, tuple(r.passes))
    assert sorted(map(key, out)) == sorted(map(key, again))
    # the running number of a source's words, inverted by bisection
    by_source = defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
    names = sorted(by_source)
    for name, members in by_source.items():
        knots = mixing.SCHEDULES[names.index(name) % 3]
        order = lambda r: (hashlib.md5(f"mix{r.doc_id}".encode()).hexdigest(), r.doc_id)
        start = 0
        for r in sorted(members, key=order):
            for k, p in enumerate(r.passes):
                number = start + k * r.source_size
                assert p.position == pytest.approx(bisect(number / r.target, knots), abs=1e-6)
            start += r.size


def integral(time, knots):
    total = 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        end = min(time, t1)
        if end > t0:
            w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
            total += (end - t0) * (w0 + w) / 2
    return total


def bisect(share, knots):
    low, high, whole = 0.0, 1.0, integral(1.0, knots)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if integral(middle, knots) < share * whole else (low, middle)
    return low


def test_training_rows_are_sorted_and_texts_whole(spark):
    rows = [(i, prose(30, i), "en", f"s{i % 4}") for i in range(200)]
    docs = sized(spark, rows)
    passes = mixing.training_rows(mixing.mix_documents(docs)).collect()
    positions = [p.position for p in passes]
    assert positions == sorted(positions)
    mixed = mixing.mixed_documents(docs.withColumn("n_chars", F.length("text")))
    words = Counter()
    for r in mixed.collect():
        assert r.text == prose(30, r.doc_id) and r.n_chars == len(r.text)
        words[r.source] += len(WORD.findall(r.text))
    want = targets({f"s{k}": 1500 for k in range(4)})
    assert all(abs(words[s] - t) <= 15.5 for s, t in want.items())  # half a document
    assert mixed.columns == [*docs.columns, "n_chars"]


def test_rows_without_an_id_are_mixed_alike_on_reruns(spark):
    rows = [(None, prose(20 + k % 50, k), "en", f"s{k % 3}") for k in range(150)]
    rows += [(7, prose(20 + k % 50, 900 + k), "en", f"s{k % 3}") for k in range(150)]
    docs = sized(spark, rows)
    mixes = [Counter(r.text for r in mixing.mixed_documents(docs.repartition(n)).collect()) for n in (1, 5)]
    assert mixes[0] == mixes[1]


def test_plan_is_native(spark):
    docs = sized(spark, [(1, "a b", "en", "a")])
    plan = mixing.mix_documents(docs)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
