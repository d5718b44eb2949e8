"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is its share of the mix, spread over training by a schedule:
weights at knots of training time (0 to 1), linear in between.  The integral of
the schedule, scaled to the source's target, is its demand for words up to any
time.  The words of a source, document after document and pass after pass, are
numbered by a running sum; inverting the demand at that number gives the
training position at which a document is due, and documents are range-sorted by
position.

Targets share all words by weight.  A target stops at ``MOST_PASSES`` times its
source's words; the excess goes to the others by weight until none is above.
In closed form: with sources sorted by words per weight, those that stop are
the first few, and one running sum over the sources finds how many.

Everything is DataFrame functions.  A source's running sum is taken in two
levels, over ``BUCKETS`` hash buckets and within a bucket, so no source lies in
one task.  The table of sources (a row each) is the only thing summed in one.

Defined results: a null or empty text has no words, is never taken and has no
position; a null source is a source of its own, last; ties in the hash order go
by ``doc_id``, then words; repeated rows are documents of their own; an empty
table, or one without words, gives targets of 0; other columns are passed
through, but for those with the name of a result, which replaces them.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.columns import passed, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Knots (time, weight) per weight: level, rising, falling.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.25), (0.5, 1.25), (1.0, 0.25)),
)
SEED = "mix"
RESULTS = ("source_size", "target", "taken", "passes")
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets

Knots = tuple[tuple[float, float], ...]


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    found = F.regexp_count(text.cast("string"), F.lit(WORD))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def inverse_demand(share: Column, knots: Knots) -> Column:
    """Time at which the schedule's integral reaches ``share`` (0 to 1) of its whole."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    found = F.lit(knots[-1][0])
    target = share * F.lit(areas[-1])
    pieces = list(zip(knots, knots[1:], areas, areas[1:], strict=False))
    for (t0, w0), (t1, w1), before, after in reversed(pieces):
        if after == before:
            continue
        slope = (w1 - w0) / (t1 - t0)
        area = target - F.lit(before)
        # area = w0 * x + slope / 2 * x * x, solved for x without cancellation
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * area)
        x = F.lit(t0) + F.lit(2.0) * area / (F.lit(w0) + root)
        found = F.when(target <= F.lit(after), x).otherwise(found)
    return F.when(share <= 0, F.lit(knots[0][0])).otherwise(found)


def _key(source: Column) -> list[Column]:
    """A source as columns that join and sort without nulls; null comes last."""
    return [source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source")]


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (_none, _source, source_size) of all sources: weight place and target."""
    by_name = Window.orderBy("_none", "_source")
    kinds = len(WEIGHTS)
    ranked = sizes.withColumn("_kind", F.pmod(F.row_number().over(by_name) - 1, F.lit(kinds)))
    weight = reduce(
        lambda found, k: F.when(F.col("_kind") == k, F.lit(WEIGHTS[k])).otherwise(found),
        range(kinds),
        F.lit(0),
    )
    ranked = ranked.withColumn("_weight", weight.cast("bigint"))
    most = F.col("source_size") * MOST_PASSES
    every = Window.partitionBy()
    before = Window.orderBy(
        most / F.col("_weight"), "_none", "_source"
    ).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.sum("_weight").over(every).alias("_weights"),
        F.coalesce(F.sum(most).over(before), F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_stopped_weight"),
    )
    stops = (F.col("_all") - F.col("_stopped")) * F.col("_weight") > most * (
        F.col("_weights") - F.col("_stopped_weight")
    )
    summed = summed.withColumn("_stops", stops)
    left = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_stops"), most)).over(every), F.lit(0))
    left_weight = F.col("_weights") - F.coalesce(
        F.sum(F.when(F.col("_stops"), F.col("_weight"))).over(every), F.lit(0)
    )
    target = F.when(F.col("_stops"), most.cast("double")).otherwise(
        left * F.col("_weight") / F.greatest(left_weight, F.lit(1))
    )
    return summed.select("_none", "_source", "source_size", "_kind", target.alias("target"))


def mix_documents(docs: DataFrame, size: str = "size", tie: Column | None = None) -> DataFrame:
    """Add source_size, target, taken and passes to every row of ``docs``.

    ``docs`` has doc_id, source and the number of words in ``size``.  ``passes``
    lists, in order, the position at which a pass over the document is due and
    the words it takes; the last pass of one document per source may stop early,
    so that the source's words meet its target.  ``tie`` tells rows of one id, or
    without one, apart: it is part of their order and of what spreads them.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if tie is not None:
        name = F.concat(name, F.lit(":"), tie.cast("string"))
    mine = docs.select(
        whole_row(),
        *_key(F.col("source")),
        F.col(size).cast("bigint").alias("_size"),
        F.md5(F.concat(F.lit(SEED), name).cast("binary")).alias("_order"),
        F.col("doc_id").alias("_id"),
    ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    source, bucket = ["_none", "_source"], ["_none", "_source", "_bucket"]
    buckets = mine.groupBy(*bucket).agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy(*source).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    targets = source_targets(
        buckets.groupBy(*source).agg(F.sum("_words").alias("source_size"))
    )
    starts = buckets.select(
        *bucket, F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before")
    ).join(targets, source)
    within = Window.partitionBy(*bucket).orderBy("_order", "_id", "_size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = mine.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(
        starts, bucket
    )
    first = F.col("_before") + F.col("_within")
    passes = F.array(
        *[
            F.struct(
                _position(first + F.lit(k) * F.col("source_size")).alias("position"),
                F.greatest(
                    F.lit(0),
                    F.least(
                        F.col("_size"),
                        F.round("target").cast("bigint")
                        - F.lit(k) * F.col("source_size") - first,
                    ),
                ).alias("words"),
            )
            for k in range(MOST_PASSES)
        ]
    )
    passes = F.filter(passes, lambda p: p["words"] > 0)
    return rows.select(
        *passed(docs, RESULTS),
        "source_size",
        "target",
        F.aggregate(passes, F.lit(0).cast("bigint"), lambda a, p: a + p["words"]).alias("taken"),
        passes.alias("passes"),
    )


def _position(number: Column) -> Column:
    share = number / F.greatest(F.col("target"), F.lit(1.0))
    return reduce(
        lambda found, k: F.when(
            F.col("_kind") == k, F.round(inverse_demand(share, SCHEDULES[k]), 9)
        ).otherwise(found),
        range(len(SCHEDULES)),
        F.lit(None).cast("double"),
    )


def in_training_order(rows: DataFrame, position: Column) -> DataFrame:
    """Range-sort by position; rows without one come last."""
    order = [position.asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_rows(mixed: DataFrame) -> DataFrame:
    """A row per document and pass, with its position and words, in training order."""
    rows = mixed.withColumn("_pass", F.explode("passes")).select(
        *[F.col(c) for c in mixed.columns if c != "passes"],
        F.col("_pass.position").alias("position"),
        F.col("_pass.words").alias("words"),
    )
    return in_training_order(rows, F.col("position"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` as they are, one per pass, in training order.

    A pass that would stop early is made whole, or left out if less than half of the
    document's words are due: no text is ever cut, and a source's words come within
    half a document of its target.
    """
    sized = docs.select(whole_row(), "doc_id", "source", words(F.col("text")).alias("size"))
    tie = F.xxhash64(F.col("_doc.text"), F.col("_doc.source"))
    rows = training_rows(mix_documents(sized, tie=tie))
    return rows.filter(2 * F.col("words") >= F.col("size")).select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns]
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents``, a row per document by the position of its first pass."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    mixed = mix_documents(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    first = F.try_element_at("passes", F.lit(1))["position"]
    return in_training_order(
        mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")),
        F.col("position"),
    )


def _sql_inverse(knots: Knots) -> str:
    """The SQL of ``inverse_demand`` for a column ``share``."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    whole, branches = f"(share * {areas[-1]!r}::DOUBLE)", ""
    for (t0, w0), (t1, w1), before, after in zip(knots, knots[1:], areas, areas[1:], strict=False):
        slope = (w1 - w0) / (t1 - t0)
        area = f"({whole} - {before!r}::DOUBLE)"
        root = f"sqrt({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {area})"
        branches += (
            f" WHEN {whole} <= {after!r}::DOUBLE THEN {t0!r}::DOUBLE"
            f" + 2.0::DOUBLE * {area} / ({w0!r}::DOUBLE + {root})"
        )
    return (
        f"round(CASE WHEN share <= 0 THEN {knots[0][0]!r}::DOUBLE{branches}"
        f" ELSE {knots[-1][0]!r}::DOUBLE END, 9)"
    )


_WEIGHT_SQL = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
_POSITION_SQL = " ".join(f"WHEN {k} THEN {_sql_inverse(s)}" for k, s in enumerate(SCHEDULES))
_TAKEN_SQL = " + ".join(
    f"greatest(0, least(size, goal - {k} * source_size - first))" for k in range(MOST_PASSES)
)

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(concat('{SEED}', coalesce(doc_id::VARCHAR, ''))) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} AS kind
      FROM s),
w AS (SELECT *, CASE kind {_WEIGHT_SQL} END AS weight, {MOST_PASSES} * source_size AS most FROM k),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
             coalesce(sum(most) OVER b, 0)::BIGINT AS stopped,
             coalesce(sum(weight) OVER b, 0)::BIGINT AS stopped_weight
      FROM w WINDOW b AS (ORDER BY most / weight, encode(source) NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, (total - stopped) * weight > most * (weights - stopped_weight) AS stops FROM c),
f AS (SELECT *, total - coalesce(sum(CASE WHEN stops THEN most END) OVER (), 0)::BIGINT AS rest,
             weights - coalesce(sum(CASE WHEN stops THEN weight END) OVER (), 0)::BIGINT AS rest_weight
      FROM e),
g AS (SELECT source, source_size, kind,
             CASE WHEN stops THEN most::DOUBLE
                  ELSE (rest * weight)::DOUBLE / greatest(rest_weight, 1) END AS target FROM f),
h AS (SELECT d.doc_id, d.size, g.source_size, g.kind, g.target, round(g.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, ({_TAKEN_SQL})::BIGINT AS taken, first::DOUBLE / greatest(target, 1.0::DOUBLE) AS share
      FROM h)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN least(size, goal - first) > 0 THEN CASE kind {_POSITION_SQL} END END AS position
FROM p
"""
