from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.operators.ranking import number_within, top_per_group


def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randint(0, 9))
            for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, g string, v int").repartition(7)


def test_numbers_agree_with_a_window(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id")]
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(repr, number_within(df, ["g"], order).collect())) == sorted(
        map(repr, plain.collect())
    )


def test_numbers_without_groups(spark):
    got = number_within(skewed(spark), [], [F.col("v"), F.col("id")]).orderBy("v", "id").collect()
    assert [r.rn for r in got] == list(range(1, 3001))


def test_hot_group_is_spread(spark):
    df = spark.range(0, 40000, 1, 8).selectExpr("id", "'one' as g")
    got = number_within(df, ["g"], [F.col("id")])
    assert got.filter(F.col("rn") != F.col("id") + 1).count() == 0


def test_top_per_group(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id")]
    window = Window.partitionBy("g").orderBy(*order)
    plain = df.withColumn("rank", F.row_number().over(window)).filter("rank <= 4")
    assert sorted(map(repr, top_per_group(df, ["g"], order, 4).collect())) == sorted(
        map(repr, plain.collect())
    )
