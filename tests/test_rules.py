"""Rules on single messages, as assertions over small DataFrames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.functions import pii, text
from triagelake.functions.words import in_flags, in_text, rule_families, with_words
from triagelake.operators import arbiter, draft, judge
from triagelake.operators.classify import classify, parse_classification
from triagelake.plans.triage import rules_only


def one(spark, value, expression):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(expression(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "message, intent",
    [
        ("there is a crack in the glass, the screen is cracked", "DEVICE_HARDWARE_ISSUE"),
        ("my password was changed and an unknown charge came", "ACCOUNT_SECURITY_BILLING"),
        ("the ios beta makes every app crash", "SOFTWARE_OS_BUG"),
        ("how do i set up a focus mode", "HOW_TO_CONFIGURATION"),
        ("the courier lost my package", "ORDER_DELIVERY_STATUS"),
        ("good morning everyone", "CHITCHAT_OUT_OF_SCOPE"),
    ],
)
def test_classifier_is_sure(spark, message, intent):
    row = classify(spark.createDataFrame([(message,)], "text string")).first()
    assert row.classification.intent == intent
    assert row.classification.confidence >= 0.85


@pytest.mark.parametrize(
    "message, intent, confidence",
    [
        ("my screen is acting weird and slow", "SOFTWARE_OS_BUG", 0.72),
        ("the screen froze after the update", "SOFTWARE_OS_BUG", 0.91),
        ("the trackpad clicks", "DEVICE_HARDWARE_ISSUE", 0.94),
        ("trackpad gestures in ios", "SOFTWARE_OS_BUG", 0.91),
        ("track it for me", "ORDER_DELIVERY_STATUS", 0.94),
        ("groups", "ORDER_DELIVERY_STATUS", 0.94),
        ("nothing at all", "SOFTWARE_OS_BUG", 0.72),
        (None, "SOFTWARE_OS_BUG", 0.72),
    ],
)
def test_rule_order(spark, message, intent, confidence):
    row = classify(spark.createDataFrame([(message,)], "text string")).first()
    assert (row.classification.intent, row.classification.confidence) == (intent, confidence)


def test_rules_are_a_parameter(spark):
    mine = (rules.IntentRule("X", 0.5, "r", ("zebra",)),)
    frame = spark.createDataFrame([("A Zebra",), ("screen",)], "text string")
    got = [r.classification.intent for r in classify(frame, intent_rules=mine).collect()]
    assert got == ["X", "SOFTWARE_OS_BUG"]


@pytest.mark.parametrize(
    "number, valid",
    [
        ("4532015012345671", True), ("4532015012345679", False), ("4222222222222", True),
        ("424242424242", False), ("4532-0150 1234-5671", True), ("", False), ("words", False),
        ("6304000000000000000", True), ("00000000000000000000", False),
    ],
)
def test_luhn(spark, number, valid):
    assert one(spark, number, pii.luhn_valid) is valid


@pytest.mark.parametrize(
    "message, kinds",
    [
        ("card 4532-0150-1234-5678 please", ["CREDIT_CARD"]),
        ("number 1234567890123 here", []),
        ("415-555-0199 or user@testdomain.com", ["EMAIL", "PHONE_NUMBER"]),
        ("ssn 000-12-3456", ["SSN"]),
        ("PWD: abc", ["PLAINTEXT_PASSWORD"]),
        ("room 555-0199", []),
        ("", []),
    ],
)
def test_pii_kinds(spark, message, kinds):
    found = one(spark, message, pii.pii_kinds)
    assert [k for k in found if k != "PHONE_NUMBER" or "PHONE_NUMBER" in kinds] == kinds


def decide(spark, message, intent, confidence, reply=None):
    frame = spark.createDataFrame(
        [(message, (intent, confidence, "r"), reply)],
        "text string, classification struct<intent:string,confidence:double,reasoning:string>, "
        "draft_text string",
    )
    return arbiter.arbitrate(frame, draft_text="draft_text").first().decision


@pytest.mark.parametrize(
    "message, intent, word",
    [
        ("My card 4532-0150-1234-5678 has a problem", "DEVICE_HARDWARE_ISSUE", "CREDIT_CARD"),
        ("Call 415-555-0199 or user@testdomain.com", "HOW_TO_CONFIGURATION", "EMAIL"),
        ("battery exploded and caught fire", "DEVICE_HARDWARE_ISSUE", "safety hazard"),
        ("filing a lawsuit, says my lawyer", "DEVICE_HARDWARE_ISSUE", "Legal threat"),
        ("Need help", "ACCOUNT_SECURITY_BILLING", "ACCOUNT_SECURITY_BILLING"),
    ],
)
def test_hard_rules(spark, message, intent, word):
    got = decide(spark, message, intent, 0.95)
    assert (got.action, got.layer, got.is_critical) == ("ESCALATE", "HARD_RULE", True)
    assert any(word in r for r in got.reasons)
    assert got.grounding_passed and got.confidence_passed and got.sanitized_draft is None


def test_hard_reasons_in_order_and_uncritical(spark):
    got = decide(spark, "bullshit, i am switching to pixel", "SOFTWARE_OS_BUG", 0.5)
    assert got.reasons == [rules.REASON_PROFANITY, rules.REASON_CHURN]
    assert not got.is_critical and not got.confidence_passed


def test_soft_rules(spark):
    low = decide(spark, "acting strange", "SOFTWARE_OS_BUG", 0.72)
    assert (low.layer, low.reasons) == (
        "SOFT_RULE", ["[Soft Filter] Low intent confidence (0.72 < 0.85)"]
    )
    link = decide(spark, "fix?", "DEVICE_HARDWARE_ISSUE", 0.92, "see http://shady.biz now ^AB")
    assert link.layer == "SOFT_RULE" and "http://shady.biz" in link.reasons[0]
    both = decide(spark, "fix?", "SOFTWARE_OS_BUG", 0.5, "100% refund, http://shady.biz")
    assert len(both.reasons) == 2 and rules.ISSUE_GUARANTEE in both.reasons[1]


def test_safe_reply_passes(spark):
    got = decide(spark, "Dark Mode?", "HOW_TO_CONFIGURATION", 0.94, "Go to Settings ^AB")
    assert (got.action, got.layer, got.sanitized_draft) == (
        "AUTO_HANDLE", "PASSED", "Go to Settings ^AB"
    )
    assert got.reasons == [rules.REASON_PASSED]


@pytest.mark.parametrize(
    "reply, expected",
    [("  hi \n", "hi ^AB"), ("hi ^VK", "hi ^VK"), ("hi ^vk", "hi ^vk ^AB"), ("hi ^TL\t", "hi ^TL"),
     ("ok ^VK\u00a0", "ok ^VK"), ("\u3000wide\u2003\u2028", "wide ^AB"), ("\x1cx\x1f", "x ^AB")],
)
def test_signoff(spark, reply, expected):
    assert one(spark, reply, draft.signed) == expected


def test_judge_guards(spark):
    rows = [
        ("my lawyer", "thanks", 2), ("my lawyer", "a human will help", 0),
        ("hi", "no idea", 1), ("hi", "read the manual", 2), ("hi", "ok", 0),
    ]
    frame = spark.createDataFrame(rows, "query string, response string, failed int")
    for row in judge.judge(frame).collect():
        if row.failed:
            assert row.judgement.overall == float(row.failed)
        else:
            assert row.judgement.rationale == rules.RATIONALE_SCORED


def test_malformed_classifications_fall_back(spark):
    good = '{"intent":"CHITCHAT_OUT_OF_SCOPE","confidence":0.9,"reasoning":"x"}'
    assert one(spark, good, parse_classification).intent == "CHITCHAT_OUT_OF_SCOPE"
    for bad in ("", "{", good.replace("0.9", "9"), good.replace("CHITCHAT", "CHAT"), None):
        assert one(spark, bad, parse_classification).confidence == 0.70


def test_message_ids(spark):
    frame = spark.createDataFrame([("a", "x"), (None, "x"), (None, "y")], "k string, t string")
    ids = [r[0] for r in frame.select(text.message_id(F.col("k"), F.col("t"))).collect()]
    assert ids[0] == "a" and ids[1] != ids[2]
    assert all(len(i) == 12 and i.startswith("twt_") for i in ids[1:])


def test_rules_job_has_no_shuffle(spark):
    frame = spark.range(10).selectExpr("id", "cast(id as string) as text")
    plan = rules_only(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def random_texts(n=400):
    """Texts of rule words, pieces of them, and things like personal data."""
    rng = random.Random(11)
    words = [w for r in rules.INTENT_RULES for w in r.any_of + r.unless + r.or_any + r.or_unless]
    words += rules.HAZARD_WORDS + rules.LEGAL_WORDS + rules.PROFANITY_WORDS + rules.CHURN_WORDS
    odd = ["PIN\u000b= x", "a@b.co", "A.B@c-d.ORG", "415-555-0199", "(212) 555 0144", "000-12-3456",
           "4532 0150-1234 5671", "4222222222222", "12345678901234567890", "x|y@z.c|m", "\u212a", "\u0130os",
           "password is\n", "9999", "\u00e9t\u00e9", ""]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            word = rng.choice(words) if rng.random() < 0.6 else rng.choice(odd)
            if rng.random() < 0.3:
                word = word[rng.randint(0, 2): len(word) - rng.randint(0, 2)]
            parts.append(word.upper() if rng.random() < 0.2 else word)
        out.append((rng.choice(["", " ", "-"]).join(parts),))
    return out


def test_word_flags_agree_with_contains(spark):
    frame = with_words(spark.createDataFrame(random_texts(), "text string"), "text")
    families = rule_families(rules.INTENT_RULES) + [
        rules.HAZARD_WORDS, rules.LEGAL_WORDS, rules.PROFANITY_WORDS, rules.CHURN_WORDS
    ]
    fast, plain = in_flags(), in_text(F.col("_lower"))
    same = [(fast(w) == plain(w)).alias(f"c{i}") for i, w in enumerate(families)]
    hits = [F.sum(plain(w).cast("int")).alias(f"n{i}") for i, w in enumerate(families)]
    assert all(all(row) for row in frame.select(*same).collect())
    assert all(n > 0 for n in frame.agg(*hits).first())


def test_hints_lose_no_personal_data(spark):
    frame = with_words(spark.createDataFrame(random_texts(), "text string"), "text")
    rows = frame.select(
        pii.pii_kinds(F.col("text")).alias("a"),
        pii.pii_kinds(F.col("text"), F.col("_words")).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in rows)
    assert {k for r in rows for k in r.a} == set(rules.PII_KINDS)


def test_luhn_of_random_numbers(spark):
    rng = random.Random(5)
    numbers = ["".join(rng.choices("0123456789", k=rng.randint(11, 21))) for _ in range(500)]

    def plain(number):
        digits = [int(c) for c in reversed(number)]
        doubled = [sum(divmod(2 * d, 10)) for d in digits[1::2]]
        return 13 <= len(digits) <= 19 and (sum(digits[::2]) + sum(doubled)) % 10 == 0

    frame = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = frame.select("n", pii.luhn_valid(F.col("n")).alias("ok")).collect()
    assert all(r.ok == plain(r.n) for r in got)


def test_filter_on_the_outcome_reads_texts_once(spark):
    frame = spark.range(10).selectExpr("id", "cast(id as string) as text")
    found = classify(frame, once=True).filter(F.col("classification.confidence") > 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
