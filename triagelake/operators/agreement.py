"""Agreement of many raters: Fleiss' kappa with missing ratings, and its error.

Items may have any number of ratings; those with fewer than two say nothing about
agreement and are left out.  An item's agreement is the share of its pairs of
ratings that agree, chance agreement comes from the shares of the categories among
all ratings of the items counted.

The standard error is the jackknife over items.  What kappa would be without an item
follows from the totals and the item's own counts, so all of them come from one pass
over a row per item.  The counts and the rows per item are written once, as every
later step reads them.  Totals per category are joined by broadcast: categories are a
scale, at most ``MAX_CATEGORIES``, which is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage

MAX_CATEGORIES = 10_000


def _kappa(agreement: Column, chance: Column) -> Column:
    return F.when(chance < 1, (agreement - chance) / (1 - chance))


def fleiss_kappa(ratings: DataFrame, item: str = "item", category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    """``items, ratings, agreement, chance, kappa, stderr`` per group of ``by``.

    A row of ``ratings`` is one rater's category for an item; null is a missing one.
    Kappa is null where chance agreement is 1 or no item has two ratings, the error
    where there are fewer than two items or kappa is null without one of them.
    """
    keys = list(by) or ["_whole"]
    if not by:
        ratings = ratings.withColumn("_whole", F.lit(0))
    counts = (
        ratings.filter(F.col(category).isNotNull())
        .groupBy(*keys, F.col(item).alias("_item"), F.col(category).alias("_category"))
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    size = F.sum("_n").over(Window.partitionBy(*keys, "_item"))
    cells = cut_lineage(counts.withColumn("_size", size).filter(F.col("_size") >= 2).drop("_size"))

    def on(left: str, right: str, names: Sequence[str]) -> list[Column]:
        return [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]

    totals = cells.groupBy(*keys, "_category").agg(F.sum("_n").alias("_all"))
    if totals.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories and groups")
    met = cells.alias("c").join(F.broadcast(totals).alias("t"), on("c", "t", [*keys, "_category"]))
    per_item = met.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c._item").alias("_item")).agg(
        F.sum("c._n").alias("_size"),
        F.sum(F.col("c._n") * F.col("c._n")).alias("_square"),
        F.sum(F.col("c._n") * F.col("t._all")).alias("_cross"),
    )
    agree = (F.col("_square") - F.col("_size")) / (F.col("_size") * (F.col("_size") - 1))
    per_item = cut_lineage(per_item.withColumn("_agree", agree))
    whole = per_item.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("_size").alias("_sizes"),
        F.sum("_agree").alias("_agreed"),
    )
    squares = totals.groupBy(*keys).agg(F.sum(F.col("_all") * F.col("_all")).alias("_squares"))
    sums = whole.alias("w").join(F.broadcast(squares).alias("q"), on("w", "q", keys))
    sums = sums.select(*[f"w.{k}" for k in keys], "items", "_sizes", "_agreed", "_squares")
    one = per_item.alias("i").join(F.broadcast(sums).alias("w"), on("i", "w", keys))
    rest = F.col("_sizes") - F.col("_size")
    others = F.col("items") - 1
    without = F.when(
        (others > 0) & (rest > 0),
        _kappa(
            (F.col("_agreed") - F.col("_agree")) / F.when(others > 0, others),
            (F.col("_squares") - 2 * F.col("_cross") + F.col("_square")) / F.when(rest > 0, rest * rest),
        ),
    )
    spread = one.groupBy(*[F.col(f"i.{k}").alias(k) for k in keys]).agg(
        F.var_samp(without).alias("_variance"), F.count(without).alias("_known"), F.count(F.lit(1)).alias("_items")
    )
    joined = sums.alias("w").join(spread.alias("v"), on("w", "v", keys))
    n = F.col("items").cast("double")
    agreement, chance = F.col("_agreed") / n, F.col("_squares") / (F.col("_sizes") * F.col("_sizes"))
    return joined.select(
        *[F.col(f"w.{k}").alias(k) for k in by],
        "items", F.col("_sizes").cast("bigint").alias("ratings"),
        agreement.alias("agreement"), chance.alias("chance"), _kappa(agreement, chance).alias("kappa"),
        F.when((n > 1) & (F.col("_known") == F.col("_items")), F.sqrt((n - 1) * (n - 1) / n * F.col("_variance")))
        .alias("stderr"),
    )
