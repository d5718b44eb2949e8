from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from triagelake import schemas
from triagelake.sources import readers, writers


def test_missing_corpus(spark, tmp_path):
    with pytest.raises(AnalysisException) as error:
        readers.load_resolutions(spark, str(tmp_path / "none.json"))
    assert error.value.getCondition() == "PATH_NOT_FOUND"


def test_array_and_lines(spark, tmp_path):
    rows = [
        {"tweet_id": "t1", "query_text": "q", "resolution_text": "r", "intent": "SOFTWARE_OS_BUG",
         "created_at": "2023-10-12T14:22:00Z"},
        {"tweet_id": "t2", "query_text": "q2"},
    ]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    a = readers.load_resolutions(spark, str(tmp_path / "array.json"), array=True)
    b = readers.load_resolutions(spark, str(tmp_path / "lines.json"))
    assert a.schema == b.schema == schemas.RESOLUTION
    assert a.orderBy("tweet_id").collect() == b.orderBy("tweet_id").collect()
    assert a.filter("created_at = timestamp'2023-10-12 14:22:00'").count() == 1


def test_golden_is_built_once(spark, tmp_path):
    path = str(tmp_path / "golden")
    templates = spark.createDataFrame(
        [(1, "a?", "SOFTWARE_OS_BUG", "ESCALATE", True, None, 4.0, None),
         (2, "b", "SOFTWARE_OS_BUG", "AUTO_HANDLE", False, None, 5.0, None)],
        "seq int, tweet_text string, expected_intent string, expected_action string, "
        "is_critical boolean, expected_escalation_reason string, human_quality_score double, "
        "context_note string",
    )
    with pytest.raises(AnalysisException):
        readers.load_golden(spark, path)
    built = readers.load_golden(spark, path, templates, 5)
    assert [r.tweet_text for r in built.orderBy("id").collect()] == [
        "a?", "b", "a? [var-2]", "b [var-3]", "a? [var-4]"
    ]
    assert readers.load_golden(spark, path).count() == 5
    assert built.schema == schemas.GOLDEN


def test_parquet_by_intent(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = spark.createDataFrame([("x", "A"), ("y", "B")], "tweet_id string, intent string")
    writers.write_parquet(frame, path, partition_by=["intent"])
    assert spark.read.parquet(path).filter("intent = 'A'").count() == 1
    with pytest.raises(AnalysisException):
        writers.write_parquet(frame, path)
