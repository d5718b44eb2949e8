"""The triage job: classify, retrieve, draft, arbitrate, route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.functions.text import message_id
from triagelake.operators import draft as drafting
from triagelake.operators.arbiter import arbitrate, route
from triagelake.operators.classify import classify
from triagelake.operators.retrieval import (
    Index, attach_attributes, build_index, searchable, with_hits,
)

ATTRIBUTES = ["tweet_id", "query_text", "resolution_text", "intent"]


def rules_only(
    messages: DataFrame, text: str = "text", threshold: float = rules.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Classify and arbitrate, without retrieval or a draft.

    Narrow: fit for a stream as it stands.
    """
    kept = messages.columns
    out = arbitrate(classify(messages, text), text, "classification", None, threshold)
    return out.select(*kept, "classification", "decision")


def index_corpus(corpus: DataFrame, path: str | None = None) -> Index:
    """The retrieval index of past resolutions, over the customers' side."""
    return build_index(searchable(corpus, "doc_id", "query_text", "embedding"), path)


def with_drafts(
    messages: DataFrame, corpus: DataFrame, text: str = "text",
    embedding: str | None = None, k: int = rules.TOP_K, rrf_k: int = rules.RRF_K,
    signoff: str = rules.SIGNOFF, resident: str | None = None, index: Index | None = None,
) -> DataFrame:
    """Add ``classification``, ``retrieved``, ``context`` and ``draft``.

    ``corpus``: doc_id (bigint), the columns of ``ATTRIBUTES`` and ``embedding``;
    ``index``: the same as ``index_corpus`` makes it, where there is one already.
    """
    index = index or index_corpus(corpus)
    hits = with_hits(messages, index, text, embedding, k, rrf_k, resident=resident)
    found = attach_attributes(classify(hits, text), corpus, ATTRIBUTES, k=k, index=index)
    contexts = found.withColumn("context", drafting.grounding_context(F.col("retrieved")))
    lower_prompt = F.lower(
        drafting.prompt(F.col(text), F.col("classification.intent"), F.col("context"))
    )
    replies = contexts.withColumn("_prompt", lower_prompt).withColumn(
        "_reply", drafting.reply_template(F.col("_prompt"))
    )
    return replies.withColumn(
        "draft",
        F.struct(
            drafting.signed(F.col("_reply"), signoff).alias("draft_text"),
            drafting.source_ids(F.col("retrieved")).alias("grounded_sources"),
            F.lit(signoff).alias("agent_signoff"),
        ),
    ).drop("_prompt", "_reply")


def triage(
    messages: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text",
    embedding: str | None = None, k: int = rules.TOP_K, rrf_k: int = rules.RRF_K,
    threshold: float = rules.CONFIDENCE_THRESHOLD, signoff: str = rules.SIGNOFF,
    resident: str | None = None, index: Index | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """One ``schemas.TRIAGE`` row per message, after the columns of ``keep``.

    With the corpus resident in the tasks the whole job is one narrow stage
    over the messages: no message is ever shuffled.
    """
    drafted = with_drafts(
        messages, corpus, text, embedding, k, rrf_k, signoff, resident, index
    )
    decided = arbitrate(
        drafted.withColumn("_draft_text", F.col("draft.draft_text")),
        text, "classification", "_draft_text", threshold,
    )
    routed = route(decided, "decision", "_draft_text")
    return routed.select(
        *keep,
        message_id(F.col(key), F.col(text)).alias("tweet_id"),
        F.col(text).alias("inbound_text"),
        "classification",
        F.col("retrieved").alias("retrieved_resolutions"),
        "draft",
        F.col("decision").alias("arbiter_decision"),
        "final_action",
        "final_response",
    )
