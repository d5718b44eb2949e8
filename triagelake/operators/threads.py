"""Threads of messages: the root, depth and earlier messages of every reply.

A message names the message it replies to.  Pointers are doubled: every message
points to its parent at first, then to what that one points to, so ``r`` rounds
climb ``2^r`` replies, and a message that has reached its root takes no further
part.  Each round is an equi-join of the messages still climbing with all messages
by key, behind a reliable checkpoint; popular messages are a skewed left side that
adaptive execution splits, as the right side has one row per key.

Defined results: a message whose parent is missing is a root of its own, marked
``orphan``; one that names itself, or whose parents lead into a circle, has no root
or depth and is marked ``circular``; a null key is a message of its own that
nobody replies to; keys must be unique otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut_lineage


def reply_roots(messages: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """``key, parent, root, depth, orphan, circular`` of every message."""
    rows = messages.select(F.col(key).alias("_id"), F.col(parent).alias("_parent"))
    known = rows.filter(F.col("_id").isNotNull()).select(F.col("_id").alias("_parent"), F.lit(True).alias("_known"))
    placed = rows.join(known, "_parent", "left")
    is_root = F.col("_known").isNull()  # no parent, or one that is not there
    state = cut_lineage(
        placed.select(
            "_id", "_parent",
            (is_root & F.col("_parent").isNotNull()).alias("_orphan"),
            F.when(is_root, F.col("_id")).otherwise(F.col("_parent")).alias("_up"),
            F.when(is_root, 0).otherwise(1).cast("bigint").alias("_depth"),
            is_root.alias("_done"),
        )
    )
    climbing = state.filter(~F.col("_done")).count()
    while climbing:
        above = state.filter(F.col("_id").isNotNull()).select(
            F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"),
            F.col("_done").alias("_arrived"),
        )
        moved = state.filter(~F.col("_done")).join(above, "_up").select(
            "_id", "_parent", "_orphan", F.col("_next").alias("_up"),
            (F.col("_depth") + F.col("_more")).alias("_depth"), F.col("_arrived").alias("_done"),
        )
        state = cut_lineage(state.filter("_done").unionByName(moved))
        left = state.filter(~F.col("_done")).count()
        if left == climbing:
            break  # nobody arrived: every message left leads into a circle
        climbing = left
    done = F.col("_done")
    return state.select(
        F.col("_id").alias(key), F.col("_parent").alias(parent),
        F.when(done, F.col("_up")).alias("root"), F.when(done, F.col("_depth")).alias("depth"),
        F.col("_orphan").alias("orphan"), (~done).alias("circular"),
    )


def thread_context(
    messages: DataFrame, turns: int, key: str = "id", parent: str = "parent_id", text: str = "text",
    separator: str = "\n",
) -> DataFrame:
    """``key, context``: the texts of up to ``turns`` messages replied to, oldest first.

    One equi-join per turn; a circle is followed round until there are enough.
    """
    above = messages.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_up"), F.col(parent).alias("_next"),
        F.coalesce(F.col(text), F.lit("")).alias("_said"),
    )
    none = F.array().cast("array<string>")
    rows = messages.select(F.col(key), F.col(parent).alias("_up"), none.alias("_texts"))
    for _ in range(turns):
        met: Column = F.concat(F.array("_said"), F.col("_texts"))
        rows = rows.join(above, "_up", "left").select(
            key, F.col("_next").alias("_up"),
            F.when(F.col("_said").isNotNull(), met).otherwise(F.col("_texts")).alias("_texts"),
        )
    return rows.select(key, F.array_join("_texts", separator).alias("context"))
