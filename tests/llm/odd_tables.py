"""Small tables with every kind of row an operator must put up with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RNG = random.Random(11)
COMMON = "the of and to in that is was for it with as on be at by this from".split()
RARE = ["".join(RNG.choices("abcdefghiklmnoprstuvw", k=RNG.randint(3, 9))) for _ in range(3000)]


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(
        rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(RARE) for _ in range(words)
    )


BASE = prose(120, 1)
NEAR = BASE.rsplit(" ", 3)[0] + " three other words"
LONG = prose(30_000, 2)
#: doc_id, text, lang, source
ROWS = [
    (1, BASE, "en", "a"),
    (1, BASE, "en", "a"),  # the same row again
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t \x0b", "en", "b"),
    (None, prose(80, 3), "en", "b"),
    (None, None, None, "b"),
    (5, LONG, "en", "c"),
    (6, BASE, None, "c"),  # an exact copy
    (7, NEAR, "en", None),  # a near copy
    (8, prose(50, 4) + "\n" + prose(50, 4), "en", "a"),  # repeats itself
    (8, prose(60, 5), "en", "a"),  # the same id with another text
    (9, "中文 Ελληνικά слово <|im_end|> <|endoftext|> é́   \\ ''", "de", "d"),
    (10, "und der die das ist nicht ein " * 30, "de", "d"),
    (11, "12 34 -- !!", "de", "d"),
    (-5, "word", "en", "a"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string"
#: Names that operators use for results or while they work.
CLASHES = (
    "n_chars", "size", "kept", "words", "n_words", "taken", "passes", "score", "log_weight",
    "shard", "part", "node", "_doc", "_text", "_words", "_key", "_id", "_hash", "_order", "lang_pred",
)


def odd(spark: SparkSession, clashes: bool = True) -> DataFrame:
    docs = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    if clashes:
        docs = docs.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES])
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark).filter(F.lit(False))


LABELS = [(1, 1, 0), (5, 1, 0), (6, None, 0), (7, 0, 0), (7, 1, 0), (9, 0, 1), (None, 1, 0), (77, 1, 0)]


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "doc_id bigint, quality bigint, toxic bigint")
