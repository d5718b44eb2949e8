"""The queue of borderline decisions: wait for a review, or escalate in time.

A message whose confidence lies between ``LOW`` and ``HIGH`` is neither handled nor
escalated at once.  It waits, keyed by its id, in the state store.  A review of it
releases or escalates it; without one it is escalated when the watermark has passed
its time by ``patience``.  Anything else passes straight through.

Times lie between the years 1678 and 2261 (nanoseconds in 64 bits).

A waiting message is gone from the state once it is decided; a review that comes first
is kept for the message as long.  Ids share the state rows of ``BUCKETS`` by their hash,
as a call of Python for every id costs far more than deciding it.  The number of buckets
belongs to a stream's checkpoint.  Replays from the checkpoint give the same outcomes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake import rules
from triagelake.session import ship_package

LOW, HIGH = 0.75, rules.CONFIDENCE_THRESHOLD
OUTCOME = "id string, outcome string, decided_at timestamp"
#: What waits, in lists of one length; times in nanoseconds, ``since`` null without a message.
_STATE = "ids array<string>, since array<bigint>, verdicts array<string>, reviewed array<bigint>"
BUCKETS = 1024


def events(messages: DataFrame, reviews: DataFrame) -> DataFrame:
    """One stream of both: ``id, at, confidence, verdict``.

    ``messages``: id, at, confidence.  ``reviews``: id, at, verdict (AUTO_HANDLE or
    ESCALATE).  Rows without an id or a time are left out.
    """
    both = messages.select(
        F.col("id").cast("string"), "at", F.col("confidence").cast("double"), F.lit(None).cast("string").alias("verdict")
    ).unionByName(
        reviews.select(
            F.col("id").cast("string"), "at", F.lit(None).cast("double").alias("confidence"), "verdict"
        )
    )
    return both.filter(F.col("id").isNotNull() & F.col("at").isNotNull())


def decide(
    rows: DataFrame, patience_ms: int, delay: str = "0 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """``id, outcome, decided_at`` of every message of ``events``, as it is decided.

    Outcomes: ``auto``, ``escalated`` (at once), ``released``, ``rejected`` (by review),
    ``timed_out``.  The first review counts; a repeated message keeps its first time.
    """

    ship_package(rows.sparkSession)
    patience = patience_ms * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # (since, verdict, reviewed) by id; since is None without a message
        kept = {i: rest for i, *rest in zip(*state.get, strict=True)} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        touched, out = set(), []
        for frame in [] if state.hasTimedOut else frames:
            times = frame["at"].astype("datetime64[ns]").astype("int64")
            columns = (frame["id"], times, frame["confidence"], frame["verdict"])
            for name, at, confidence, verdict in zip(*(c.tolist() for c in columns), strict=True):
                if isinstance(verdict, str) or LOW < confidence < HIGH:
                    touched.add(name)
                    own = kept.setdefault(name, [None, None, None])
                    if isinstance(verdict, str):
                        if own[1] is None or at < own[2]:
                            own[1:] = verdict, at
                    elif own[0] is None or at < own[0]:
                        own[0] = at
                else:
                    if name in kept:
                        touched.add(name)
                    out.append((name, "auto" if confidence >= HIGH else "escalated", at))
        least = None
        for name, (since, verdict, reviewed) in list(kept.items()):
            limit = (reviewed if since is None else since) // 1_000_000 + patience_ms
            if name in touched and since is not None and verdict is not None and reviewed <= since + patience:
                out.append((name, "released" if verdict == rules.AUTO_HANDLE else "rejected", max(since, reviewed)))
                del kept[name]
            elif limit < watermark or (limit == watermark and name in touched):
                if since is not None:
                    out.append((name, "timed_out", since + patience))
                del kept[name]
            else:
                least = limit if least is None else min(least, limit)
        if kept:
            state.update(tuple(map(list, zip(*((i, *rest) for i, rest in kept.items()), strict=True))))
            state.setTimeoutTimestamp(max(least, watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            ids, outcomes, decided = zip(*out, strict=True)
            yield pd.DataFrame({"id": ids, "outcome": outcomes, "decided_at": pd.to_datetime(decided)})

    return (
        rows.withWatermark("at", delay)
        .withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandasWithState(run, OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
