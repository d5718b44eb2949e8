"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, written as Parquet, and its
decisions take effect: documents that the classifier or the language
identification rejects go, one document of each group of near copies stays,
passes of the mix become rows, and the last stage returns the pieces of the
packed sequences.  All but the last return the columns they were given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.jaccard_join import one_of_each_group
from triagelake.llm.language_id import identified_documents
from triagelake.llm.mixing import mixed_documents
from triagelake.llm.packing import place, token_pieces
from triagelake.llm.quality_classifier import sampled_documents
from triagelake.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_documents(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return place(token_pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashing, tokenizing and the packing program are not SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
