"""The quality classifier: held-out accuracy, the draw by brute force, odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from odd_tables import ROWS, empty, labels, odd, prose
from pyspark.sql import functions as F

from triagelake.llm import quality_classifier as qc


def junk(seed):
    rng = random.Random(seed)
    return " ".join(w.upper() + "!!" for w in prose(60, rng.randrange(10**6)).split())


@pytest.fixture(scope="module")
def tables(spark):
    texts = [(k, prose(20 + k % 200, k)) for k in range(1500)]
    texts += [(2000 + k, junk(k)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    marks = [(i, int(i < 2000), 0) for i, _ in texts if i % 3]
    return docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_clean_unlabelled_documents_stay_and_junk_goes(tables):
    rows = qc.resample(*tables).collect()
    unlabelled = [r for r in rows if r.doc_id % 3 == 0]
    clean = [r.kept for r in unlabelled if r.doc_id < 2000]
    assert np.mean(clean) > 0.99
    assert not any(r.kept for r in unlabelled if r.doc_id >= 2000)


def test_draw_is_top_k_of_weight_and_noise(spark, tables):
    docs, marks = tables
    rows = qc.resample(docs, marks).collect()
    keys = sorted((r.sampling_key for r in rows), reverse=True)
    k = sum(r.kept for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.sampling_key >= keys[k - 1]}
    noise = np.array([r.sampling_key - r.log_weight for r in rows])
    assert noise.mean() == pytest.approx(0.5772, abs=0.12) and noise.std() == pytest.approx(1.28, abs=0.12)
    again = qc.resample(docs.repartition(3), marks).collect()
    assert {(r.doc_id, r.kept) for r in rows} == {(r.doc_id, r.kept) for r in again}


def test_ratio_matches_plain_counts(spark, tables):
    docs, marks = tables
    model = qc.fit(docs, marks)
    raw, target = np.zeros(qc.BUCKETS), np.zeros(qc.BUCKETS)
    good = {r.doc_id for r in marks.filter("quality = 1 AND toxic = 0").collect()}
    for r in docs.collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        single, pair, following, _ = qc._buckets(data, np.array([0, len(data)]))
        every = np.concatenate((single, pair[following]))
        assert len(every) == 2 * len(r.text.split()) - 1
        np.add.at(raw, every, 1)
        if r.doc_id in good:
            np.add.at(target, every, 1)
    expected = raw * target.sum() / raw.sum()
    want = np.log((target + qc.SMOOTHING) / (expected + qc.SMOOTHING))
    assert np.allclose(model.whole, want)


def test_toxic_words_in_clean_texts_are_rejected(spark):
    """Three forms of a few insults in hundreds of clean words, in documents without a label."""
    rng = random.Random(5)

    def toxic(k):
        words = prose(150 + k, 5000 + k).split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(("zkrumpfa", "qvorbel")) + rng.choice("abcde"))
        return " ".join(words)

    texts = [(k, prose(20 + k % 200, k)) for k in range(1200)]
    texts += [(2000 + k, toxic(k)) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    marks = spark.createDataFrame(
        [(i, 1, int(i >= 2000)) for i, _ in texts if i % 3], "doc_id bigint, quality int, toxic int"
    )
    rows = [r for r in qc.resample(docs, marks).collect() if r.doc_id % 3 == 0]
    assert np.mean([r.kept for r in rows if r.doc_id >= 2000]) < 0.05
    assert np.mean([r.kept for r in rows if r.doc_id < 2000]) > 0.98


def test_best_cut():
    assert qc.best_cut({-1: 500, -9: 1}, {-10: 3, -5: 7}) == -2.5
    assert qc.best_cut({-1: 100, -9: 1}, {-10: 3, -5: 7}) == -9.0
    assert qc.best_cut({-5: 4}, {-5: 4}) == qc.best_cut({}, {-5: 4}) == -np.inf


@pytest.mark.parametrize("k", [1, 2, 777, 4000, 4999, 5000, 9000])
def test_kth_largest(spark, k):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(4000)] + [0.25] * 1000
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert qc.kth_largest(rows, "v", k) == sorted(values, reverse=True)[min(k, 5000) - 1]


def test_kth_largest_narrows(spark):
    values = spark.range(60_000).select((F.col("id") * 0.5).alias("v"))
    assert qc.kth_largest(values, "v", 40_000) == 10_000.0
    same = spark.range(30_000).select(F.lit(2.0).alias("v"))
    assert qc.kth_largest(same, "v", 5) == 2.0


def test_bounded_labels(spark):
    marks = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")
    )
    some = qc.label_sample(marks, 100)
    assert some.count() == 100
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in qc.label_sample(marks, 100).collect()}


def test_odd_rows(spark):
    docs = odd(spark)
    out = qc.resample(docs, labels(spark))
    assert len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    for r in rows:
        if not (r.text or "").split():
            assert not r.kept and r.log_weight == 0.0
    twins = {(r.log_weight, r.sampling_key, r.kept) for r in rows if r.doc_id == 1}
    assert len(twins) == 1
    kept = qc.sampled_documents(docs, labels(spark))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_no_labels_or_no_rows(spark):
    none = labels(spark).filter(F.lit(False))
    rows = qc.resample(odd(spark), none).collect()
    assert all(r.kept == bool((r.text or "").split()) for r in rows)
    assert qc.resample(empty(spark), labels(spark)).count() == 0
