"""Stratified evaluation sets: every class brought to the same number of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators.ranking import number_within

# Copies are listed in runs of this many, so that no list grows with the quota.
_RUN = 4096


def expand_to_quota(
    templates: DataFrame,
    quota: int = rules.GOLDEN_QUOTA,
    classes: Sequence[str] = rules.INTENTS,
    label: str = "expected_intent",
    order: str = "seq",
) -> DataFrame:
    """Cycle each class's templates, in ``order``, to exactly ``quota`` items.

    Adds ``n``, the 0-based number within the class, and the class's ``_size``.  A template at position p of
    s appears as items p, p + s, p + 2s and so on: no class is gathered anywhere.
    """
    known = templates.filter(F.col(label).isin(*classes))
    placed = number_within(known, [label], [F.col(order)], "_rn")
    # one count per class at most, so the sizes go along as a constant
    sizes = placed.groupBy(label).agg(F.max("_rn").alias("n")).collect()
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r[label], r["n"])])
    size = size[F.col(label)] if sizes else F.lit(None).cast("bigint")
    p, s = F.col("_rn") - 1, F.col("_size")
    copies = F.floor((F.lit(quota) - 1 - p) / s) + 1
    sized = placed.withColumn("_size", size).filter(p < quota).withColumn("_copies", copies)
    runs = sized.withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / _RUN)))
    )
    first = F.col("_run") * _RUN
    items = runs.withColumn(
        "_copy", F.explode(F.sequence(first, F.least(first + _RUN, F.col("_copies")) - 1))
    )
    return items.withColumn("n", p + F.col("_copy") * s).drop("_rn", "_copies", "_run", "_copy")


def golden_set(
    templates: DataFrame,
    quota: int = rules.GOLDEN_QUOTA,
    classes: Sequence[str] = rules.INTENTS,
    order: str = "seq",
) -> DataFrame:
    """Golden rows (``schemas.GOLDEN``) from templates with the same fields.

    Items after the first pass over a class carry `` [var-n]``, after every
    question mark or else at the end.  Ids run through the classes in order.
    """
    items = expand_to_quota(templates, quota, classes, "expected_intent", order)
    suffix = F.concat(F.lit(" [var-"), F.col("n").cast("string"), F.lit("]"))
    text = F.col("tweet_text")
    varied = (
        F.when(F.col("n") < F.col("_size"), text)
        .when(text.contains("?"), F.replace(text, F.lit("?"), F.concat(F.lit("?"), suffix)))
        .otherwise(F.concat(text, suffix))
    )
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("expected_intent")) - 1
    number = (place * quota + F.col("n") + 1).cast("bigint")
    return items.select(
        F.format_string("gold_%03d", number).alias("id"),
        varied.alias("tweet_text"),
        "expected_intent",
        "expected_action",
        "is_critical",
        "expected_escalation_reason",
        "human_quality_score",
        "context_note",
        F.lit(rules.GOLDEN_REPLY).alias("gold_reference_reply"),
    )
