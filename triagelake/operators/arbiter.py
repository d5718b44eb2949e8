"""Escalate or handle automatically: hard rules first, then soft rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.functions.pii import pii_kinds
from triagelake.functions.text import any_of, contains_any
from triagelake.functions.words import FLAGS, in_flags, with_words


def first_foreign_url(draft_text: Column) -> Column:
    """The first link that names none of the official domains, or null."""
    urls = F.regexp_extract_all(draft_text, F.lit(rules.URL_PATTERN), F.lit(0))
    foreign = F.filter(urls, lambda u: ~any_of(u.contains(d) for d in rules.OFFICIAL_DOMAINS))
    return F.try_element_at(foreign, F.lit(1))


def grounding_issue(draft_text: Column) -> Column:
    """Why a draft may not go out, or null; banned promises come before links."""
    url = first_foreign_url(draft_text)
    return F.when(
        contains_any(F.lower(draft_text), rules.BANNED_PROMISES), F.lit(rules.ISSUE_GUARANTEE)
    ).when(url.isNotNull(), F.concat(F.lit(rules.ISSUE_URL), url))


def low_confidence_reason(confidence: Column, threshold: float) -> Column:
    return F.concat(
        F.lit(rules.REASON_LOW_CONFIDENCE),
        F.format_string("%.2f", confidence),
        F.lit(f" < {threshold})"),
    )


def _present(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def arbitrate(
    df: DataFrame,
    text: str = "text",
    classification: str = "classification",
    draft_text: str | None = None,
    threshold: float = rules.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Add ``decision``, a ``schemas.DECISION`` struct (narrow, no shuffle).

    Any hard reason settles the matter before the soft rules; ``draft_text``
    names the column of the drafted reply, null where there is none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = df.columns
    if FLAGS not in kept:
        df = with_words(df, text)
    has = in_flags()
    intent = F.col(classification).getField("intent")
    confidence = F.col(classification).getField("confidence")
    draft = F.col(draft_text) if draft_text else F.lit(None).cast("string")

    found = df.withColumn("_pii", pii_kinds(body, F.col(FLAGS))).withColumn(
        "_flags",
        F.struct(
            has(rules.HAZARD_WORDS).alias("hazard"),
            has(rules.LEGAL_WORDS).alias("legal"),
            has(rules.PROFANITY_WORDS).alias("profanity"),
            has(rules.CHURN_WORDS).alias("churn"),
            (intent == rules.RESTRICTED_INTENT).alias("restricted"),
            (confidence >= threshold).alias("confident"),
            grounding_issue(draft).alias("issue"),
        ),
    )
    flag = F.col("_flags").getField
    has_pii = F.size("_pii") > 0
    reasoned = found.withColumn(
        "_hard",
        _present(
            F.when(has_pii, F.concat(F.lit(rules.REASON_PII), F.array_join("_pii", ", "))),
            F.when(flag("hazard"), rules.REASON_HAZARD),
            F.when(flag("legal"), rules.REASON_LEGAL),
            F.when(flag("profanity"), rules.REASON_PROFANITY),
            F.when(flag("churn"), rules.REASON_CHURN),
            F.when(flag("restricted"), rules.REASON_RESTRICTED),
        ),
    ).withColumn(
        "_soft",
        _present(
            F.when(~flag("confident"), low_confidence_reason(confidence, threshold)),
            F.when(
                flag("issue").isNotNull(),
                F.concat(F.lit(rules.REASON_GROUNDING), flag("issue")),
            ),
        ),
    )
    hard, soft = F.size("_hard") > 0, F.size("_soft") > 0
    passed = ~hard & ~soft
    decision = F.struct(
        F.when(passed, rules.AUTO_HANDLE).otherwise(rules.ESCALATE).alias("action"),
        F.when(hard, "HARD_RULE").when(soft, "SOFT_RULE").otherwise("PASSED").alias("layer"),
        F.when(hard, F.col("_hard"))
        .when(soft, F.col("_soft"))
        .otherwise(F.array(F.lit(rules.REASON_PASSED)))
        .alias("reasons"),
        (has_pii | flag("hazard") | flag("legal") | flag("restricted")).alias("is_critical"),
        flag("confident").alias("confidence_passed"),
        (hard | flag("issue").isNull()).alias("grounding_passed"),
        F.when(passed, draft).alias("sanitized_draft"),
    )
    return reasoned.select(*kept, decision.alias("decision"))


def route(df: DataFrame, decision: str = "decision", draft_text: str = "draft_text") -> DataFrame:
    """Add ``final_action`` and ``final_response``."""
    action = F.col(decision).getField("action")
    reasons = F.array_join(F.col(decision).getField("reasons"), "; ")
    return df.withColumn("final_action", action).withColumn(
        "final_response",
        F.when(action == rules.AUTO_HANDLE, F.col(draft_text)).otherwise(
            F.concat(F.lit(rules.ROUTED_PREFIX), reasons)
        ),
    )
