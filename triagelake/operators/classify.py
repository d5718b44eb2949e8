"""Intent classification by ordered word rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake import rules, schemas
from triagelake.functions.words import Matcher, in_flags, with_words


def rule_hits(has: Matcher, rule: rules.IntentRule) -> Column:
    hit = has(rule.any_of)
    if rule.unless:
        hit = hit & ~has(rule.unless)
    if rule.or_any:
        also = has(rule.or_any)
        if rule.or_unless:
            also = also & ~has(rule.or_unless)
        hit = hit | also
    return hit


def _outcome(rule: rules.IntentRule) -> Column:
    return F.struct(
        F.lit(rule.intent).alias("intent"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.reasoning).alias("reasoning"),
    )


def classification(
    has: Matcher,
    intent_rules: Sequence[rules.IntentRule] = rules.INTENT_RULES,
    default: rules.IntentRule = rules.DEFAULT_INTENT,
) -> Column:
    """The first rule that hits, as a ``schemas.CLASSIFICATION`` struct.

    ``has`` tells whether a word list hits: ``in_text`` or ``in_flags``.  ``when`` branches are evaluated in order and only as far as needed.
    """
    chain = F.when(F.lit(False), _outcome(default))
    for rule in intent_rules:
        chain = chain.when(rule_hits(has, rule), _outcome(rule))
    return chain.otherwise(_outcome(default))


def classify(
    messages: DataFrame,
    text: str = "text",
    intent_rules: Sequence[rules.IntentRule] = rules.INTENT_RULES,
    default: rules.IntentRule = rules.DEFAULT_INTENT,
    once: bool = False,
) -> DataFrame:
    """Add ``classification`` (narrow, no shuffle).

    The lower-cased text ``_lower`` and the word flags ``_words`` stay in the
    result for the arbiter to use.  Filters on other columns reach the scan;
    ``once`` is for jobs that filter on the outcome (see ``word_flags``).
    """
    found = with_words(messages, text, intent_rules, once=once)
    return found.withColumn("classification", classification(in_flags(), intent_rules, default))


def parse_classification(payload: Column) -> Column:
    """A classification from JSON text; anything malformed becomes the fallback."""
    parsed = F.from_json(payload, schemas.CLASSIFICATION, {"mode": "PERMISSIVE"})
    valid = (
        parsed.getField("intent").isin(*rules.INTENTS)
        & parsed.getField("confidence").between(0.0, 1.0)
        & parsed.getField("reasoning").isNotNull()
    )
    return F.when(valid, parsed).otherwise(_outcome(rules.FALLBACK_INTENT))
