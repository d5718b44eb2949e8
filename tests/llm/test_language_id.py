"""Language identification: accuracy on mixed texts, Viterbi against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd
from pyspark.sql import functions as F

from triagelake.llm import language_id as lid

WORDS = {
    "de": "der die das und nicht schön straße über mein haus ich wir gehen heute zug weiß".split(),
    "en": "the and with this house we are going today by train which would through thought".split(),
    "ru": "это дом мы идем сегодня поезд который через мысль нельзя хорошо".split(),
    "uk": "це дім ми йдемо сьогодні поїзд який через думка не можна їжак ґанок".split(),
}


def text(lang, count, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS[lang], k=count))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(text(lang, 40, k), lang) for lang in WORDS for k in range(40)]
    rows += [(None, "de"), ("", "en"), (text("ru", 10, 1), None)]
    return lid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def found(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = docs.select("k", lid.identify(docs.text, model).alias("f")).orderBy("k").collect()
    return [r.f for r in rows]


def test_languages_and_scripts(model):
    assert model.languages == ("de", "en", "ru", "uk")
    latin, cyrillic = 1, 3
    assert model.candidates[latin].tolist() == [True, True, False, False]
    assert model.candidates[cyrillic].tolist() == [False, False, True, True]


def test_unseen_texts(spark, model):
    cases = [(lang, text(lang, n, 1000 + n)) for lang in WORDS for n in (8, 20, 300, 20_000)]
    got = found(spark, model, [t for _, t in cases])
    assert [g.lang for g in got] == [lang for lang, _ in cases]
    assert all(g.score > 0.9 for g in got)


def test_spans_of_mixed_text(spark, model):
    whole = f"{text('de', 30, 1)} -- {text('en', 20, 2)} 12 {text('ru', 25, 3)}"
    (got,) = found(spark, model, [whole])
    spans = [(s.lang, s.first_word, s.words) for s in got.spans]
    assert [s[0] for s in spans] == ["de", "en", "ru"]
    words = whole.split()
    for lang, first, count in spans:
        inside = [w for w in words[first : first + count] if w.isalpha()]
        assert sum(w in WORDS[lang] for w in inside) >= len(inside) - 1
    assert 0.2 < got.score < 0.6


def test_undetermined(spark, model):
    got = found(spark, model, [None, "", "12 34 -- !!", " \n", "中文"])
    assert [(g.lang, g.score, len(g.spans)) for g in got[:4]] == [("und", 0.0, 0)] * 4
    assert got[4].lang == "de"  # no candidate: neutral, the first language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 5, 3, 0, 6]
    scores = rng.normal(scale=8, size=(sum(lengths), 3)).astype(np.float32)
    words = np.concatenate(([0], np.cumsum(lengths)))
    labels = lid._viterbi(scores, words)
    for a, b in zip(words[:-1], words[1:], strict=True):
        def value(path, a=a):
            switches = sum(x != y for x, y in zip(path, path[1:], strict=False))
            return sum(scores[a + i, s] for i, s in enumerate(path)) - lid.SWITCH * switches
        best = max(map(value, itertools.product(range(3), repeat=b - a)))
        assert value(tuple(labels[a:b])) == pytest.approx(best, abs=1e-3)


def test_odd_rows(spark):
    docs = odd(spark)
    model = lid.train_on(docs)
    assert set(model.languages) <= {"de", "en"}
    out = docs.select("*", lid.identify(docs.text, model).alias("_found")).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    kept = lid.identified_documents(docs)
    assert kept.columns == docs.columns
    # texts without a letter go; what fits no language may go as well, copies alike
    letters = Counter(r[0] for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))
    rows = kept.collect()
    assert not Counter(r.doc_id for r in rows) - letters and len(rows) >= sum(letters.values()) - 3
    assert sum(r.text == ROWS[0][1] for r in rows) in (0, 3)


def test_empty_table_or_no_labels(spark, model):
    assert lid.identified_documents(empty(spark)).count() == 0
    none = lid.train(spark.createDataFrame([("a b", None)], "text string, lang string"))
    assert none.languages == ()
    assert found(spark, none, ["a b"])[0].lang == "und"


def test_unlearned_languages_are_rejected(spark):
    """Finnish in a known script, Chinese in an unknown one, and half a text of each kind."""
    fi = "talo olemme menossa tänään junalla joka kautta ajatus yö hyvää kiitos paljon".split()
    rng = random.Random(3)
    rows = [(k, text(lang, 30, k), lang) for lang in ("de", "en") for k in range(2000)]
    rows += [(10_000 + k, " ".join(rng.choices(fi, k=30)), None) for k in range(20)]
    rows += [(20_000, "中文" * 20, None), (20_001, "中文" * 20 + " " + text("de", 2, 1), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    kept = [r.doc_id for r in lid.identified_documents(docs).collect()]
    assert not [i for i in kept if i >= 10_000]
    assert len(kept) > 0.98 * 4000
    out = docs.select("doc_id", lid.identify(docs.text, lid.train_on(docs)).alias("f"))
    strange = {r.doc_id: r.f for r in out.filter("doc_id >= 10000").collect()}
    assert all(f.lang in ("de", "en") for f in strange.values())
    assert strange[20_000].score == 0.0 and 0 < strange[20_001].score < 0.3


def test_held_out_labels_are_not_read(spark):
    """Without them, and with others in their place, every value is the same."""
    rows = [(k, text(lang, 5 + k % 60, k), lang) for k in range(300) for lang in ("de", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    held = lid.held_out(F.col("doc_id"))
    results = []
    for other in (F.col("lang"), F.lit(None).cast("string"), F.lit("xx"), F.lit("de")):
        changed = docs.withColumn("lang", F.when(held, other).otherwise(F.col("lang")))
        model = lid.train_on(changed)
        assert np.isfinite(model.floors).all()
        found_ = changed.select("doc_id", "text", lid.identify(changed.text, model).alias("f"))
        results.append(Counter((r.doc_id, r.text, r.f.lang, r.f.score, r.f.fit) for r in found_.collect()))
    assert all(r == results[0] for r in results[1:])


@pytest.mark.parametrize("texts", [30, 300])
def test_floors_at_any_size(spark, texts):
    fi = "talo olemme menossa tänään junalla joka kautta ajatus yö hyvää kiitos paljon".split()
    rng = random.Random(9)
    rows = [(k, text(lang, 40, k), lang) for k in range(texts) for lang in ("de", "en")]
    rows += [(10_000 + k, " ".join(rng.choices(fi, k=40)), None) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    kept = [r.doc_id for r in lid.identified_documents(docs).collect()]
    assert not [i for i in kept if i >= 10_000]
    assert len(kept) >= 0.97 * 2 * texts


def test_fitted_floors_by_hand():
    rng = np.random.default_rng(1)
    lang, length = rng.integers(0, 2, 40_000), rng.integers(3, 12, 40_000)
    letters = 1.5 * 2.0**length
    mean = np.where(lang == 0, -7.0, -8.0) + rng.normal(size=40_000) * np.sqrt(0.01 + 2 / letters)
    floors = lid.fitted_floors(lang, length, np.floor(mean / lid.STEP).astype(int), np.ones(40_000, int), 2)
    assert abs((mean < floors[length, lang]).mean() - lid.LOSS) < 0.002
    for k in (3, 11):
        want = -7.0 - lid.DEEP * np.sqrt(0.01 + 2 / (1.5 * 2**k))
        assert floors[k, 0] == pytest.approx(want, abs=0.08)
    one = lid.fitted_floors(np.array([1]), np.array([5]), np.array([-300]), np.array([1]), 3)
    assert np.isfinite(one).all()


def test_viterbi_with_many_languages():
    scores = np.zeros((6, 300), np.float32)
    scores[:3, 200] = scores[3:, 299] = 50
    assert lid._viterbi(scores, np.array([0, 6])).tolist() == [200] * 3 + [299] * 3
