"""Readers with a fixed schema; a missing path is Spark's own error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from triagelake import rules, schemas
from triagelake.operators.golden import golden_set
from triagelake.sources import writers
from triagelake.sources.json_arrays import read_json_array


def _json(spark: SparkSession, path: str, schema, array: bool) -> DataFrame:
    return read_json_array(spark, path, schema) if array else spark.read.schema(schema).json(path)


def load_resolutions(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Past resolutions from JSON lines, or from files holding JSON arrays."""
    return _json(spark, path, schemas.RESOLUTION, array)


def load_golden(
    spark: SparkSession,
    path: str,
    templates: DataFrame | None = None,
    quota: int = rules.GOLDEN_QUOTA,
    array: bool = False,
) -> DataFrame:
    """The golden set at ``path``; built from ``templates`` first where missing."""
    try:
        return _json(spark, path, schemas.GOLDEN, array)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or templates is None:
            raise
    writers.write_json(golden_set(templates, quota), path)
    return _json(spark, path, schemas.GOLDEN, False)


def load_vectors(
    spark: SparkSession, path: str, key: str = "doc_id", vector: str = "embedding"
) -> DataFrame:
    """Stored vectors by key."""
    table = spark.read.parquet(path)
    return table.select(table[key].cast("bigint").alias("doc_id"),
                        table[vector].cast("array<float>").alias("embedding"))
