"""The published figures of the golden set, reproduced from its templates."""

from __future__ import annotations

import pytest
from golden_templates import TEMPLATES
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators.golden import expand_to_quota, golden_set
from triagelake.plans import evaluation as ev
from triagelake.plans.triage import triage
from triagelake.queries import fixtures
from triagelake.session import cut_lineage

CORPUS = [
    (0, "t0", "phone will not start", "Hold the side button. ^AB", "DEVICE_HARDWARE_ISSUE"),
    (1, "t1", "where is my parcel", "See the order page. ^AB", "ORDER_DELIVERY_STATUS"),
    (2, "t2", "how do i share photos", "Open the sharing menu. ^AB", "HOW_TO_CONFIGURATION"),
    (3, "t3", "app closes by itself", "Install it again. ^AB", "SOFTWARE_OS_BUG"),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows, seq = [], 0
    for intent, items in TEMPLATES.items():
        for text, action, critical, score in items:
            rows.append((seq, text, intent, action, critical, None, score, None))
            seq += 1
    templates = spark.createDataFrame(
        rows,
        "seq int, tweet_text string, expected_intent string, expected_action string, "
        "is_critical boolean, expected_escalation_reason string, human_quality_score double, "
        "context_note string",
    )
    return cut_lineage(golden_set(templates))


@pytest.fixture(scope="module")
def evaluated(spark, golden):
    corpus = spark.createDataFrame(
        CORPUS, "doc_id bigint, tweet_id string, query_text string, resolution_text string, intent string"
    ).withColumn("embedding", F.lit(None).cast("array<float>"))
    return ev.judged_predictions(golden, corpus)


def test_class_sizes_need_no_exchange(spark):
    rows = [(i, f"t{i}", rules.INTENTS[i % 2]) for i in range(9)]
    templates = spark.createDataFrame(rows, "seq int, tweet_text string, expected_intent string")
    items = expand_to_quota(templates, 7)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "BroadcastExchange" not in plan.split("Join")[0]
    got = {(r.expected_intent, r.n, r.seq) for r in items.collect()}
    assert got == {
        (rules.INTENTS[c], n, c + 2 * (n % size)) for c, size in ((0, 5), (1, 4)) for n in range(7)
    }


def test_shape(golden):
    assert golden.count() == 180 and golden.select("id").distinct().count() == 180
    counts = {tuple(r)[:2]: r["count"] for r in golden.groupBy("expected_action", "is_critical").count().collect()}
    assert counts == {("AUTO_HANDLE", False): 120, ("ESCALATE", True): 50, ("ESCALATE", False): 10}
    texts = {r.id: r.tweet_text for r in golden.collect()}
    first = TEMPLATES["DEVICE_HARDWARE_ISSUE"]
    assert texts["gold_001"] == first[0][0]
    assert texts["gold_017"] == first[0][0].replace("?", "? [var-16]")
    assert texts["gold_018"] == first[1][0] + " [var-17]"
    assert texts["gold_031"] == TEMPLATES["SOFTWARE_OS_BUG"][0][0]


def test_comparison(evaluated):
    table = {r.system: r for r in ev.compare(evaluated[1]).collect()}
    one, two, three = (table[s] for s in rules.SYSTEMS)
    assert one.macro_f1 == pytest.approx(0.047619047619047616)
    assert two.macro_f1 == pytest.approx(0.8952751702969525)
    assert three.macro_f1 == pytest.approx(0.8952751702969525)
    assert (one.deflection_rate, one.fahr, one.cer) == (0.0, 0.0, 0.0)
    assert (two.deflection_rate, two.fahr, two.cer) == (100.0, 33.33, 100.0)
    assert (three.deflection_rate, three.fahr, three.cer) == (62.22, 0.0, 0.0)
    assert (one.grounding, one.tone, one.actionability) == (2.94, 3.89, 2.94)
    assert (two.grounding, two.tone, two.actionability) == (3.64, 2.86, 3.53)
    assert (one.cohens_kappa, two.cohens_kappa) == (-0.0077, 0.026)


def test_stored_outcomes_are_joined_by_id(spark, golden, evaluated):
    corpus = spark.createDataFrame(
        CORPUS, "doc_id bigint, tweet_id string, query_text string, resolution_text string, intent string"
    ).withColumn("embedding", F.lit(None).cast("array<float>"))
    joined = ev.predictions(golden.orderBy(F.desc("id")), triage(golden, corpus, "id", "tweet_text"))
    columns = evaluated[0].columns
    assert sorted(map(repr, joined.select(columns).collect())) == sorted(
        map(repr, evaluated[0].collect())
    )


def test_classes(evaluated):
    table = {
        r.label: r for r in ev.per_class(evaluated[1]).collect() if r.system == rules.SYSTEMS[2]
    }
    expected = {
        "DEVICE_HARDWARE_ISSUE": (0.9375, 1.0, 0.967741935483871),
        "SOFTWARE_OS_BUG": (0.7027027027027027, 0.8666666666666667, 0.7761194029850746),
        "ACCOUNT_SECURITY_BILLING": (0.8620689655172413, 0.8333333333333334, 0.847457627118644),
        "HOW_TO_CONFIGURATION": (1.0, 0.9333333333333333, 0.9655172413793104),
        "ORDER_DELIVERY_STATUS": (0.9166666666666666, 0.7333333333333333, 0.8148148148148148),
        "CHITCHAT_OUT_OF_SCOPE": (1.0, 1.0, 1.0),
    }
    for label, values in expected.items():
        row = table[label]
        assert (row.precision, row.recall, row.f1_score) == pytest.approx(values)
        assert row.support == 30


def test_layers(evaluated):
    reasons = evaluated[0].select("triage.action", F.element_at("reasons", 1).alias("r")).collect()
    layers = ["PASSED" if r.action == "AUTO_HANDLE" else r.r[1:5] for r in reasons]
    assert {x: layers.count(x) for x in set(layers)} == {"PASSED": 112, "Hard": 53, "Soft": 15}


def test_failures(evaluated):
    report = ev.failure_report(evaluated[0]).collect()
    assert [(r.failure_mode, r.total_occurrences) for r in report] == [(rules.MODE_INTENT, 19)]
    examples = report[0].representative_examples
    assert [e.predicted_intent for e in examples] == [
        "ACCOUNT_SECURITY_BILLING", "DEVICE_HARDWARE_ISSUE"
    ]
    assert examples[0].details == (
        "Classified as ACCOUNT_SECURITY_BILLING instead of SOFTWARE_OS_BUG"
    )


def test_calibration(spark):
    row = ev.calibration(fixtures.frame(spark, "calibration")).first()
    assert (row.n, row.cohens_kappa) == (25, 0.9278)


def test_payload(spark, evaluated):
    judged = evaluated[1]
    row = ev.payload(
        ev.compare(judged), ev.per_class(judged), ev.calibration(fixtures.frame(spark, "calibration"))
    ).first()
    assert row.golden_set_size == 180 and set(row.systems) == set(rules.SYSTEMS)
    assert row.systems[rules.SYSTEMS[2]].cohens_kappa == 0.9278
    assert len(row.systems[rules.SYSTEMS[2]].per_intent_metrics) == 6
    assert row.systems[rules.SYSTEMS[0]].per_intent_metrics is None
