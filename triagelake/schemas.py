"""Schemas of every record the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _fields(spec: str) -> T.StructType:
    """A struct from ``name type, name type``; works without a session."""
    pairs = (field.split() for field in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CLASSIFICATION = _fields("intent string, confidence double, reasoning string")

RETRIEVED = _fields(
    "tweet_id string, query_text string, resolution_text string, intent string, "
    "bm25_score double, dense_score double, rrf_score double"
)

DRAFT = _fields("draft_text string, grounded_sources array<string>, agent_signoff string")

DECISION = _fields(
    "action string, layer string, reasons array<string>, is_critical boolean, "
    "confidence_passed boolean, grounding_passed boolean, sanitized_draft string"
)

MESSAGE = _fields("id string, text string")

RESOLUTION = _fields(
    "tweet_id string, inbound_id string, author_id string, query_text string, "
    "resolution_text string, intent string, created_at timestamp"
)

GOLDEN = _fields(
    "id string, tweet_text string, expected_intent string, expected_action string, "
    "is_critical boolean, expected_escalation_reason string, human_quality_score double, "
    "context_note string, gold_reference_reply string"
)

JUDGEMENT = _fields(
    "grounding int, tone int, actionability int, overall double, rationale string"
)

BASELINE = _fields(
    "predicted_intent string, action string, response string, escalation_reason string"
)

FAILURE = _fields(
    "mode string, tweet_text string, details string, gold_intent string, "
    "predicted_intent string, confidence double, gold_action string, "
    "predicted_action string, reasons array<string>"
)

HIT = _fields(
    "doc_id bigint, bm25_score double, dense_score double, rrf_score double, "
    "bm25_rank bigint, dense_rank bigint"
)

TRIAGE = (
    T.StructType()
    .add("tweet_id", "string")
    .add("inbound_text", "string")
    .add("classification", CLASSIFICATION)
    .add("retrieved_resolutions", T.ArrayType(RETRIEVED))
    .add("draft", DRAFT)
    .add("arbiter_decision", DECISION)
    .add("final_action", "string")
    .add("final_response", "string")
)
