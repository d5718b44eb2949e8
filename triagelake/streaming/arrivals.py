"""Messages that arrive again or late, and live figures over them.

``first_arrivals`` lets a message through once: its key, or the hash of its whole
text, is kept in the state store until the watermark has passed its time by
``delay``, across restarts from the same checkpoint; then the state is dropped.

``routing_windows`` are the routing metrics of event-time windows.  A window is
final, and written, when the watermark has passed its end; rows that come later are
dropped and counted (``late_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagelake.operators.metrics import routing_aggregates, routing_rates

KEY = "message_key"


def content_key(key: Column, text: Column) -> Column:
    """The given key, else all 256 bits of the text's hash: no two texts share one."""
    return F.coalesce(key.cast("string"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def first_arrivals(
    messages: DataFrame, time: str, delay: str, key: str | None = "id", text: str = "text"
) -> DataFrame:
    """``messages`` with ``message_key``, repeats within ``delay`` left out.

    A message without a time is never behind the watermark and is let through as it
    is the first time; one that comes more than ``delay`` late is dropped.
    """
    given = F.col(key) if key else F.lit(None).cast("string")
    keyed = messages.withColumn(KEY, content_key(given, F.col(text)))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([KEY])


def routing_windows(
    decided: DataFrame, time: str, window: str, delay: str, expected: str = "expected_action",
    action: str = "action", critical: str = "is_critical",
) -> DataFrame:
    """``start, end`` and the routing metrics of each window of event time."""
    counts = (
        decided.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("_window"))
        .agg(*routing_aggregates(expected, action, critical))
    )
    return counts.select(
        F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "*", *routing_rates()
    ).drop("_window")


def late_rows(query: StreamingQuery) -> int:
    """Rows the query's stateful steps have dropped as late, by its recent progress.

    Rows of one task and window are added up before they reach the state of a window and
    count as one there; ``first_arrivals`` counts message by message.
    """
    dropped = 0
    for progress in query.recentProgress:
        for step in progress["stateOperators"]:
            dropped += step["numRowsDroppedByWatermark"]
    return dropped
