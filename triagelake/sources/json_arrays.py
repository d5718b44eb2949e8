"""JSON arrays of objects, read by many tasks.

A file that holds one JSON value cannot be cut at line breaks.  It can be cut at
closing braces: Spark reads it as text with ``}`` as the line separator, split by
split like any text.  What a brace means depends on what stands before it -- it may
lie in a string, or close an inner object -- so the file is read twice:

* first every split is summed up: what it does to the reader's state, for either
  state it may begin in (within a string or not): a row per split;
* with the state that each split really begins in, its objects are cut out where
  they lie.  The one object that a split begins and does not end is put together
  from its fragments, a row per split again.

The text itself is never shuffled.  Objects may be nested, strings may hold braces,
brackets, quotes and escapes.  Of any other value (numbers, strings, arrays of arrays)
only the objects in it are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.session import ship_package

_ESCAPED = re.compile(r"\\.", re.DOTALL)


def outside(piece: str, in_string: bool) -> tuple[int, bool]:
    """How many objects a piece opens, and whether it ends within a string."""
    parts = _ESCAPED.sub("", piece).split('"')
    opened = sum(p.count("{") for p in parts[int(in_string) :: 2])
    return opened, in_string ^ (len(parts) % 2 == 0)


def first_open(piece: str, in_string: bool) -> int:
    """Where the first object of a piece opens."""
    for found in re.finditer(r'\\.|["{]', piece, re.DOTALL):
        if found.group() == '"':
            in_string = not in_string
        elif found.group() == "{" and not in_string:
            return found.start()
    return -1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        file, block, value = (batch.column(c) for c in ("file", "block", "value"))
        for k in range(batch.num_rows):
            yield file[k].as_py(), block[k].as_py(), value[k].as_py()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and state it begins in: the depth it adds, and the state it ends in.

    The lowest depth on the way tells whether the object open at its end began in it.
    """
    now, ends = None, []
    rows: list[tuple] = []

    def close() -> None:
        if now is not None:
            rows.extend((*now, start, *end) for start, end in enumerate(ends))

    for file, block, piece in _pieces(batches):
        if now != (file, block):
            close()
            now, ends = (file, block), [[0, 0, 0], [0, 1, 0]]
        for end in ends:
            opened, within = outside(piece, bool(end[1]))
            end[0] += opened - (not within)
            end[1] = int(within)
            end[2] = min(end[2], end[0])
    close()
    if rows:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["file", "block", "start", "depth", "within", "lowest"],
        )


def _states(rows) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(in a string, depth, split where the open object began) at the start of every split."""
    of_file: dict[str, dict[int, dict[int, tuple]]] = {}
    for r in rows:
        of_file.setdefault(r["file"], {}).setdefault(r["block"], {})[r["start"]] = r
    out = {}
    for file, blocks in of_file.items():
        within, depth, origin = False, 0, 0
        for block in sorted(blocks):
            out[file, block] = (within, depth, origin)
            end = blocks[block][int(within)]
            if depth + end["lowest"] <= 0:  # it was closed here; another one may be open
                origin = block
            within, depth = bool(end["within"]), depth + end["depth"]
    return out


def _cut(states: dict[tuple[str, int], tuple[bool, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, within, depth, origin, held = None, False, 0, 0, []
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            out = pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["file", "origin", "block", "value"],
            )
            rows.clear()
            return out

        def fragment() -> None:
            """What is open at the end of a split, under the split where it began."""
            if now is not None and held and depth > 0:
                rows.append((now[0], origin, now[1], "".join(held)))

        for file, block, piece in _pieces(batches):
            if now != (file, block):
                fragment()
                now, held = (file, block), []
                within, depth, origin = states[file, block]
            opened, ends_within = outside(piece, within)
            if depth == 0 and opened:
                piece, origin = piece[first_open(piece, within) :], block
            within, depth = ends_within, depth + opened
            if depth > 0:
                held.append(piece + "}")
            if not within and depth > 0:
                depth -= 1
                if depth == 0:
                    whole = origin == block
                    rows.append((file, None if whole else origin, block, "".join(held)))
                    held = []
            if len(rows) >= 2000:
                yield batch()
        fragment()
        if rows:
            yield batch()

    return run


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every object at the top of the JSON arrays under ``path``."""
    ship_package(spark)
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    summed = text.mapInArrow(
        _summed, "file string, block bigint, start int, depth bigint, within int, lowest bigint"
    ).collect()  # two rows per split
    cut = text.mapInArrow(_cut(_states(summed)), "file string, origin bigint, block bigint, value string")
    fragments = (
        cut.filter(F.col("origin").isNotNull())
        .groupBy("file", "origin")
        .agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("f"))
        .select(F.array_join("f.value", "").alias("value"))
    )
    return cut.filter(F.col("origin").isNull()).select("value").unionByName(fragments)


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """The objects as rows of ``schema``."""
    rows = json_objects(spark, path).select(F.from_json("value", schema).alias("r"))
    return rows.select("r.*")
