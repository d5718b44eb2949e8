"""Row numbers that hold up when one group has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """1-based position of each row within its ``keys`` group, in ``order``.

    ``order`` must settle every tie.  A plain ``row_number`` sorts a whole group
    in one task; here the rows are range-sorted by (keys, order), so a large
    group spans many partitions.  Each (partition, group) piece then needs only
    the number of rows of its group in earlier pieces, from a small count table.
    The sorted rows are written once, so that pieces and counts agree.
    """
    sort = [F.col(k).asc() for k in keys] + list(order)
    pieces = cut_lineage(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_piece", F.spark_partition_id())
        # the low 33 bits count the rows of a partition
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    # A row per (partition, group): at most one group per piece boundary is split.
    counts = pieces.groupBy("_piece", *keys).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "_piece", *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    # Null-safe on the keys; the piece number spreads a large group over the join.
    matched = pieces.alias("p").join(
        offsets.alias("o"),
        [F.col("p._piece") == F.col("o._piece")]
        + [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys],
    )
    return matched.select(
        *[F.col(f"p.{c}") for c in df.columns],
        (F.col("p._pos") - F.col("o._first") + F.col("o._before") + 1).alias(name),
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group, numbered from 1.

    Spark keeps only ``k`` rows per group and partition before the shuffle
    (window group limit); the salted step does the same once more, so the last
    step sees ``k`` rows per group and salt at most, however many partitions.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(64))
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(salted))
        .filter(F.col("_rn") <= k)
        .drop("_rn", "_salt")
        .withColumn(name, F.row_number().over(final))
        .filter(F.col(name) <= k)
    )
