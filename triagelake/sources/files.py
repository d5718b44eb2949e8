"""Files of a shared store, through the file systems Spark itself uses.

Paths may name any store that the session's Hadoop configuration knows; a path
without a scheme lies on the default one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, sorted; none where it is missing."""
    if not exists(spark, path):
        return []
    found = _system(spark, path).listStatus(_path(spark, path))
    return sorted(s.getPath().getName() for s in found)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = _system(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move ``source`` to ``target`` in one step; False if there is a target already."""
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(options, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _system(spark, target).getUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(_path(spark, source), _path(spark, target), none)
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all it holds."""
    _system(spark, path).delete(_path(spark, path), True)
