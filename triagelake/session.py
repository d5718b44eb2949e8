"""Session helpers: a local session for tests, the shared folder of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SMALL_SCAN = 16  # splits: 2 GB at the default split size


def local_session(cores: int | str = 8, app: str = "triagelake") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cores = int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session.  Only a local master may
    go without it; there a fresh temporary folder is set for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="triagelake-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    A reliable checkpoint: the rows stay the same when executors are lost, which
    matters wherever a later step joins rows with numbers derived from them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small scan, of at most ``SMALL_SCAN`` splits, over all cores.

    A file with one row group is read by one task, however many splits it has.
    Any larger table is read where it lies, whatever the size of the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, SMALL_SCAN) else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Spark serves the archive to its executors, as ``--py-files`` would.
    """
    context = spark.sparkContext
    if getattr(context, "_triagelake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="triagelake-py-"), "triagelake")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "triagelake"))
    context._triagelake_shipped = True
