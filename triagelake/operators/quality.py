"""Schema rules as a data-quality job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import rules


def violations(
    df: DataFrame,
    key: str = "id",
    intent: str = "intent",
    confidence: str = "confidence",
    action: str = "action",
) -> DataFrame:
    """One row per (record, broken rule): ``key``, ``rule``."""
    checks = {
        "confidence_range": F.col(confidence).between(0.0, 1.0),
        "intent_domain": F.col(intent).isin(*rules.INTENTS),
        "action_domain": F.col(action).isin(*rules.ACTIONS),
    }
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])
    )
    return df.select(F.col(key), F.explode(broken).alias("rule"))
