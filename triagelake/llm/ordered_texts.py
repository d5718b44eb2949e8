"""Texts brought into ascending ``doc_id`` order, in ranges that tasks read row by row.

Texts travel compressed, so the one shuffle moves about a third of the bytes.
Ranges come from quantiles of ``doc_id``, read from that column alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.workers import prepare

RANGES_PER_PARTITION = 4
SCHEMA = "part int, guest boolean, doc_id bigint, tie bigint, packed binary"


def shuffle_partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Upper bounds of ``doc_id`` ranges of about equal counts; at most ``ranges - 1``."""
    steps = [k / ranges for k in range(1, ranges)]
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).approxQuantile(
        "doc_id", steps, 1 / (4 * ranges)
    )
    return sorted({int(x) for x in found})


def _part(bounds: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Number of the range of each id; null ids come first."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    parts = np.searchsorted(bounds, values, "left").astype(np.int32)
    parts[ids.is_null().to_numpy(zero_copy_only=False)] = 0
    return parts


def first_ids(docs: DataFrame, bounds: list[int]) -> list[tuple[int, int | None]]:
    """(range, smallest id in it) of all ranges with rows, ascending; null is smallest.

    A row per range comes to the driver, and there are as many ranges as
    ``in_order`` asks for.
    """
    edges = np.array(bounds, np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            table = pa.table({"part": _part(edges, ids), "doc_id": ids, "blank": ids.is_null()})
            table = table.group_by("part").aggregate([("doc_id", "min"), ("blank", "max")])
            yield from table.select(["part", "doc_id_min", "blank_max"]).to_batches()

    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
        .mapInArrow(least, "part int, least bigint, blank boolean")
        .groupBy("part")
        .agg(F.min("least").alias("least"), F.max("blank").alias("blank"))
        .collect()
    )
    return sorted(
        ((r["part"], None if r["blank"] else r["least"]) for r in rows), key=lambda r: r[0]
    )


def in_order(docs: DataFrame, with_next: bool = False) -> DataFrame:
    """All texts in ranges, sorted by (part, doc_id, tie) within each partition.

    A range lies whole in one partition.  With ``with_next``, the rows of the
    smallest id of each following range come along as guests at the end, so
    that every document's successor is at hand; after the last range follows
    the first.  Equal ids are ordered by a hash of the text; a null text is
    empty and travels as null.
    """
    spark = docs.sparkSession
    prepare(spark)
    count = shuffle_partitions(docs)
    bounds = range_bounds(docs, RANGES_PER_PARTITION * count)
    edges = np.array(bounds, np.int64)
    guests: dict[int | None, int] = {}
    if with_next:
        firsts = first_ids(docs, bounds)
        for k, (_, least) in enumerate(firsts):
            guests[least] = firsts[k - 1][0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        schema = pa.schema(
            [
                ("part", pa.int32()),
                ("guest", pa.bool_()),
                ("doc_id", pa.int64()),
                ("tie", pa.int64()),
                ("packed", pa.binary()),
            ]
        )
        for batch in batches:
            ids, texts, ties = batch.column(0), batch.column(1), batch.column(2)
            parts = _part(edges, ids)
            packed = [
                None if t is None else press.compress(t.as_buffer())
                for t in (x if x.is_valid else None for x in texts)
            ]
            rows = pa.record_batch(
                [pa.array(parts), pa.array(np.zeros(len(parts), bool)), ids, ties,
                 pa.array(packed, pa.binary())],
                schema=schema,
            )
            yield rows
            if guests:
                extra = [k for k, i in enumerate(ids.to_pylist()) if i in guests]
                if extra:
                    some = rows.take(pa.array(extra))
                    to = [guests[i] for i in some.column(2).to_pylist()]
                    yield pa.record_batch(
                        [pa.array(to, pa.int32()), pa.array([True] * len(to)),
                         some.column(2), some.column(3), some.column(4)],
                        schema=schema,
                    )

    packed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"),
    ).mapInArrow(pack, SCHEMA)
    return packed.repartition(count, "part").sortWithinPartitions(
        "part", "guest", "doc_id", "tie"
    )


def unpack(packed: bytes | None) -> str:
    return "" if packed is None else zstandard.decompress(packed).decode("utf-8")
