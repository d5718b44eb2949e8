"""Sharding: vector bin packing of groups of equal texts by bytes, words and rows.

Every group is a vector of its share of all bytes, words and rows.  It goes to
the shard where the dot product with the capacity left is highest, among those
it fits in; larger groups first.

* A group too large for one shard is split into as few pieces as fit, by a hash
  of ``doc_id``; no other group is split.
* The law is bytes: where the three dimensions cannot all be met, bytes stay even
  and the others give way.
* Groups above ``LARGE`` of a shard are few whatever the input (at most
  ``shards / LARGE`` per dimension) and are placed first, in one go.
* All others are dealt into cells of about ``CELL_GROUPS`` by a hash.  A cell
  fills its share of the capacity that the large groups leave, with its own
  small last groups evening it out, so the cells need not know of each other.

Defined results: a null text has no bytes or words and a null checksum, and all
null texts are one group; repeated rows are members of their group like any
other; rows with a null ``doc_id`` are sharded too; an empty table gives an
empty result; other columns are not read.  A rerun gives the same shards.
"""

from __future__ import annotations

import os
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.ranking import number_within
from triagelake.llm.workers import prepare
from triagelake.session import cut_lineage

SHARDS = 24
LARGE = 1 / 256
CELL_GROUPS = 20_000
ROW_BYTES = 8
WORD = r"[^\x20\x09-\x0D]+"
GROUP = ["_hash", "_crc", "_bytes", "_piece"]


def facts(docs: DataFrame) -> DataFrame:
    """What sharding needs to know of every document; the text itself stays behind."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("_words"),
        F.xxhash64(text).alias("_hash"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("_crc"),
        F.coalesce(F.octet_length(text), F.lit(-1)).cast("bigint").alias("_bytes"),
    )


def dot_product_packing(
    loads: np.ndarray, capacity: np.ndarray, order: np.ndarray | None = None
) -> np.ndarray:
    """Shard of each group.  ``loads``: groups x dimensions; ``capacity``: shards x
    dimensions, and is used up in place.  Large first, then by row number.

    Where no shard has room in every dimension, those with room in the first
    (bytes) stand in; where none has, the one with most of it left takes the group.
    """
    shards = np.empty(len(loads), np.int32)
    if order is None:
        order = np.argsort(-loads.max(axis=1), kind="stable")
    for k in order:
        load = loads[k]
        dots = capacity @ load
        room = capacity >= load
        fits = room.all(axis=1)
        if not fits.any():
            fits = room[:, 0]
        if fits.any():
            best = int(np.where(fits, dots, -np.inf).argmax())
        else:
            best = int(capacity[:, 0].argmax())
        capacity[best] -= load
        shards[k] = best
    return shards


def _shares(total: dict) -> list[Column]:
    """A group's share of all bytes, words and rows."""
    return [
        (F.col(c) / F.lit(float(total[c] or 1))).alias(f"_share_{c}") for c in ("b", "w", "n")
    ]


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(
        F.sum("size").alias("b"), F.sum("_words").alias("w"), F.count(F.lit(1)).alias("n")
    )


def shard_groups(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their piece, groups with their shard)."""
    rows = rows.withColumn("_piece", F.lit(0))
    groups = cut_lineage(_groups(rows))
    total = groups.agg(
        F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n")
    ).first().asDict()
    share = F.greatest(*_shares(total))
    # at most `shards` groups per dimension exceed one shard
    heavy = groups.withColumn("_pieces", F.ceil(share * shards).cast("int")).filter(
        F.col("_pieces") > 1
    ).collect()
    if heavy:
        keys = rows.sparkSession.createDataFrame(
            [(r["_hash"], r["_crc"], r["_bytes"], r["_pieces"]) for r in heavy],
            "_hash bigint, _crc bigint, _bytes bigint, _pieces int",
        )
        rows = rows.join(F.broadcast(keys), ["_hash", "_crc", "_bytes"], "left").withColumn(
            "_piece",
            F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int"), F.lit(0)),
        ).drop("_pieces")
        groups = cut_lineage(_groups(rows))
    shared = groups.select(*GROUP, *_shares(total)).withColumn(
        "_most", F.greatest("_share_b", "_share_w", "_share_n")
    )
    names = ["_share_b", "_share_w", "_share_n"]
    is_large = F.col("_most") > LARGE / shards
    large = shared.filter(is_large).orderBy(F.col("_most").desc(), *GROUP).collect()
    capacity = np.full((shards, 3), 1.0 / shards)
    loads = np.array([[r[c] for c in names] for r in large], np.float64).reshape(-1, 3)
    chosen = dot_product_packing(loads, capacity, np.arange(len(loads)))
    placed = rows.sparkSession.createDataFrame(
        [(*(r[c] for c in GROUP), int(s)) for r, s in zip(large, chosen, strict=True)],
        "_hash bigint, _crc bigint, _bytes bigint, _piece int, shard int",
    )
    small = shared.filter(~is_large)
    cells = max(1, round(small.count() / CELL_GROUPS))
    rest = np.clip(capacity, 0, None)
    rest = rest / np.maximum(rest.sum(axis=0), 1e-12)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_most", *GROUP], ascending=[False] + [True] * 4)
        loads = frame[names].to_numpy(np.float64)
        room = rest * loads.sum(axis=0)
        frame = frame[GROUP].copy()
        frame["shard"] = dot_product_packing(loads, room, np.arange(len(loads)))
        return frame

    filled = (
        small.withColumn("_cell", F.pmod(F.xxhash64(*GROUP), F.lit(cells)))
        .groupBy("_cell")
        .applyInPandas(fill, "_hash bigint, _crc bigint, _bytes bigint, _piece int, shard int")
    )
    return rows, filled.unionByName(placed)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (from 0 within the shard), grown_shard."""
    prepare(docs.sparkSession)
    rows, groups = shard_groups(cut_lineage(facts(docs)), shards)
    matches = reduce(
        lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in GROUP]
    )
    placed = rows.alias("r").join(groups.alias("g"), matches).select(
        "r.doc_id", "r.size", "r.text_crc32", F.lit("bytes").alias("law"), "g.shard"
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return number_within(placed, ["shard"], order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 24 shards of nearly equal bytes, words and rows."""
    return shard_documents(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
