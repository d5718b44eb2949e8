"""The whole job: schema, streams, row order and partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triagelake import rules, schemas
from triagelake.functions import words
from triagelake.functions.words import family, with_words
from triagelake.operators import retrieval
from triagelake.operators.classify import classify
from triagelake.operators.failures import summarise
from triagelake.plans import evaluation
from triagelake.plans.triage import rules_only, triage, with_drafts
from triagelake.streaming import triage_stream as ts

MESSAGES = [
    ("m1", "how do i turn on airdrop for a colleague"),
    ("m2", "somebody used my account, i see a charge from lima"),
    ("m3", "screen cracked"), ("m4", "call 415-555-0199"), ("m5", ""), (None, "hello there"),
]
CORPUS = [
    (0, "t0", "battery drains", "Check the settings. ^AB", "DEVICE_HARDWARE_ISSUE"),
    (1, "t1", "airdrop to everyone", "Open the menu. ^AB", "HOW_TO_CONFIGURATION"),
    (2, "t2", "charged twice", "We are sorry. ^AB", "ACCOUNT_SECURITY_BILLING"),
    (3, "t3", "app closes", "Install again. ^AB", "SOFTWARE_OS_BUG"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        CORPUS, "doc_id bigint, tweet_id string, query_text string, resolution_text string, intent string"
    ).withColumn("embedding", F.lit(None).cast("array<float>"))


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES, schemas.MESSAGE)


def _types(schema):
    return schema.simpleString()


def test_end_to_end(messages, corpus):
    done = triage(messages, corpus)
    assert _types(done.schema) == _types(schemas.TRIAGE)
    rows = {r.inbound_text: r for r in done.collect()}
    safe, bad = rows[MESSAGES[0][1]], rows[MESSAGES[1][1]]
    assert (safe.tweet_id, safe.final_action) == ("m1", "AUTO_HANDLE")
    assert safe.classification.intent == "HOW_TO_CONFIGURATION" and "^" in safe.final_response
    assert len(safe.retrieved_resolutions) == 3 and "t1" in safe.draft.grounded_sources
    assert bad.final_action == "ESCALATE"
    assert bad.final_response.startswith("[ROUTED TO HUMAN SPECIALIST]")
    assert rows["hello there"].tweet_id.startswith("twt_")


def test_fewer_documents_than_asked_for(messages, corpus):
    rows = triage(messages, corpus.filter("doc_id < 2")).collect()
    assert {len(r.retrieved_resolutions) for r in rows} == {2}


def test_order_and_partitions_do_not_matter(messages, corpus):
    def run(m, c):
        return sorted(map(repr, triage(m, c).collect()))

    one = run(messages.coalesce(1), corpus.coalesce(1))
    assert one == run(messages.repartition(4).orderBy(F.desc("text")), corpus.repartition(3))


def test_stream_equals_batch(spark, messages, corpus, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages.repartition(3).write.parquet(source)
    stream = ts.read_messages(spark, source, max_files=1)
    ts.write_stream(ts.triage_stream(stream), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(repr, spark.read.parquet(out).collect())) == sorted(
        map(repr, rules_only(messages).collect())
    )
    # nothing new, nothing added
    ts.write_stream(ts.triage_stream(stream), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == len(MESSAGES)


def test_stream_with_retrieval_equals_batch(spark, messages, corpus, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages.repartition(2).write.parquet(source)
    ts.write_triage_stream(
        ts.read_messages(spark, source, max_files=1), corpus, out, str(tmp_path / "state")
    ).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, triage(messages, corpus).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_pass_classification(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = [(f"m{i}", "my screen is cracked", "en" if i % 2 else "de") for i in range(40)]
    spark.createDataFrame(rows, "id string, text string, lang string").write.parquet(path)
    stored = spark.read.parquet(path)
    for job in (classify(stored), rules_only(stored)):
        kept = job.filter("lang = 'en'")
        assert "EqualTo(lang,en)" in _plan(kept) and kept.count() == 20
        assert _plan(kept).count("ArrowEvalPython") == 1


def test_matching_once_keeps_filters_above(spark):
    frame = spark.createDataFrame([("screen cracked",), ("hi",)], "text string")
    flag = F.col("_words").getField(family(rules.PROFANITY_WORDS))
    plan = _plan(with_words(frame, "text", once=True).filter(~flag))
    assert plan.count("ArrowEvalPython") == 1


def test_evaluation_matches_words_once(spark, corpus, monkeypatch):
    calls = []
    real = words.word_flags
    monkeypatch.setattr(words, "word_flags", lambda *a: calls.append(1) or real(*a))
    golden = spark.createDataFrame(
        [("doc_1", "screen cracked", "DEVICE_HARDWARE_ISSUE", "AUTO_HANDLE", False, 5.0)],
        "id string, tweet_text string, expected_intent string, expected_action string, "
        "is_critical boolean, human_quality_score double",
    )
    evaluation.judged_predictions(golden, corpus)
    assert len(calls) == 1


def test_drafts_beyond_the_bounds_move_no_message(messages, corpus, monkeypatch):
    """Copies of messages or of the corpus by bucket were what filled the disks."""
    whole = sorted(map(repr, with_drafts(messages, corpus).select("id", "draft").collect()))
    for name in ("MAX_RESIDENT_DOCS", "MAX_RESIDENT_QUERIES", "MAX_SHARD_DOCS"):
        monkeypatch.setattr(retrieval, name, 2)
    drafted = with_drafts(messages, corpus).select("id", "draft")
    assert "Exchange" not in _plan(drafted)
    assert sorted(map(repr, drafted.collect())) == whole


def test_triage_beyond_the_bounds_is_the_same(spark, messages, corpus, monkeypatch):
    both = messages.unionByName(messages.limit(2)).unionByName(messages.filter("id IS NULL"))
    whole = sorted(map(repr, triage(both, corpus).collect()))
    for name in ("MAX_RESIDENT_DOCS", "MAX_RESIDENT_QUERIES", "MAX_SHARD_DOCS"):
        monkeypatch.setattr(retrieval, name, 2)
    assert sorted(map(repr, triage(both, corpus).collect())) == whole
    assert len(whole) == len(MESSAGES) + 3


def test_no_message_is_moved_however_large_the_corpus(spark, messages, corpus, monkeypatch):
    assert "Exchange hash" not in _plan(triage(messages, corpus))
    for name in ("MAX_RESIDENT_DOCS", "MAX_RESIDENT_QUERIES", "MAX_SHARD_DOCS"):
        monkeypatch.setattr(retrieval, name, 2)
    assert "Exchange hash" not in _plan(triage(messages, corpus))


def test_failures_come_in_the_order_of_the_items(spark):
    fields = "predicted_intent string, action string, response string, escalation_reason string"
    rows = [
        (f"doc_{i}", i, "x", "ORDER_DELIVERY_STATUS", "AUTO_HANDLE",
         ("SOFTWARE_OS_BUG" if 998 <= i <= 1001 else "ORDER_DELIVERY_STATUS", "AUTO_HANDLE", "", ""), 0.9, [])
        for i in range(2, 1100)
    ]
    predicted = spark.createDataFrame(
        rows,
        "id string, seq bigint, tweet_text string, expected_intent string, expected_action string, "
        f"triage struct<{fields.replace(' string', ':string')}>, confidence double, "
        "reasons array<string>",
    ).repartition(5)
    for order in ("seq", None):
        marked = evaluation.failures(predicted, order).withColumn(
            "tweet_text", F.col("seq").cast("string")
        )
        shown = summarise(marked, "seq").first().representative_examples
        assert [e.tweet_text for e in shown] == (
            ["998", "999"] if order else ["{7, doc_998}", "{7, doc_999}"]
        )


@pytest.mark.parametrize("folder", [False, True])
def test_a_stream_reads_a_table_that_is_a_file_or_a_folder(spark, messages, tmp_path, folder):
    """Large tables are folders of part files, whose names say nothing of the table."""
    messages.coalesce(1).write.parquet(str(tmp_path / "written"))
    source, out = tmp_path / "tables", str(tmp_path / "out")
    place = source / "messages.parquet"
    (place if folder else source).mkdir(parents=True)
    for part in (tmp_path / "written").glob("*.parquet"):
        (place / part.name if folder else place).write_bytes(part.read_bytes())
    (source / "other.parquet").write_bytes(b"not a table")
    stream = ts.read_messages(spark, str(source), messages.schema, file_glob="messages.parquet")
    ts.write_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(spark.read.parquet(out).collect(), key=str) == sorted(messages.collect(), key=str)
