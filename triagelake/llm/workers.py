"""What the Python workers of these operators need: the package, and small batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from triagelake.session import ship_package

BATCH_BYTES = 4 * 1024 * 1024
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches by bytes.

    Texts may be long, and a task holds a batch several times over, in the JVM
    and in Python.  A session that sets the limit itself keeps its own.
    """
    ship_package(spark)
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_BYTES))
