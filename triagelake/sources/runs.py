"""Results kept run by run: a reader sees whole runs, a repeated run counts once.

Two phases.  A run's rows are first staged in a folder of their own that nobody
reads; tasks that are repeated or lost on the way leave nothing in force.  Then one
version file (``sources.versions``) is published that names the folder under the run's
id, in place of an earlier one of that id.  A run that dies before that is as if it
had not been; run again under its id, it counts once however often it was tried.

Writers at the same time do not lose each other's runs: the later one takes the
version published meanwhile and adds to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from triagelake.sources import files, versions

TRIES = 20


class RunTable:
    """A table of runs under ``path``, stored as ``format``."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format = spark, path, format

    def runs(self) -> dict[str, dict]:
        """Folder and schema of every run in force, by id."""
        return versions.latest(self.spark, self.path)[1] or {}

    def stage(self, rows: DataFrame, run: str) -> dict:
        """First phase: the rows of a run, written where no reader looks."""
        folder = f"data/{run}-{uuid.uuid4().hex}"
        rows.write.format(self.format).save(f"{self.path}/{folder}")
        return {"folder": folder, "schema": rows.schema.json()}

    def commit(self, run: str, staged: dict) -> None:
        """Second phase: the staged rows take the place of the run's earlier ones."""
        for _ in range(TRIES):
            version, content = versions.latest(self.spark, self.path)
            try:
                versions.publish(self.spark, self.path, version + 1, {**(content or {}), run: staged})
                return
            except versions.Conflict:
                continue  # add to what the other writer published
        raise versions.Conflict(f"{self.path}: no version left after {TRIES} tries")

    def write(self, rows: DataFrame, run: str) -> None:
        self.commit(run, self.stage(rows, run))

    def read(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Rows of the runs given, or of all in force, in the schema of the newest."""
        held = self.runs()
        wanted = [held[r] for r in (sorted(held) if runs is None else runs)]
        if not wanted:
            raise ValueError(f"no run in force under {self.path}")
        newest = StructType.fromJson(json.loads(wanted[-1]["schema"]))
        folders = [f"{self.path}/{w['folder']}" for w in wanted]
        return self.spark.read.schema(newest).format(self.format).load(folders)

    def clean(self) -> int:
        """Remove folders that no version in force names; how many.

        Not while a run is being staged or an earlier version is still read.
        """
        used = {w["folder"].split("/")[1] for w in self.runs().values()}
        dead = [n for n in files.names(self.spark, f"{self.path}/data") if n not in used]
        for name in dead:
            files.remove(self.spark, f"{self.path}/data/{name}")
        return len(dead)
