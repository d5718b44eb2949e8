"""Versions of a stored thing: immutable data, and one small file that says what counts.

A change writes its data under names nobody reads yet, then publishes the next
version, a JSON file that lists all data in force, by one rename that fails if
another writer was first.  A reader takes the newest version and sees a change
whole or not at all; a run that dies before the rename leaves the old version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from triagelake.sources import files

FOLDER = "versions"


class Conflict(RuntimeError):
    """Another writer published the version first; nothing of this change counts."""


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The newest version and what it says; (0, None) where there is none."""
    done = [n for n in files.names(spark, f"{path}/{FOLDER}") if n.endswith(".json")]
    if not done:
        return 0, None
    return int(done[-1].split(".")[0]), json.loads(files.read_text(spark, f"{path}/{FOLDER}/{done[-1]}"))


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    staged = f"{path}/{FOLDER}/.{version:010d}-{uuid.uuid4().hex}"
    files.write_text(spark, staged, json.dumps(content, sort_keys=True))
    if not files.rename_new(spark, staged, f"{path}/{FOLDER}/{version:010d}.json"):
        raise Conflict(f"version {version} of {path} is taken")
