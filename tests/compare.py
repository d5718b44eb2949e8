"""Compare a registered query with its SQL on the given tables.

``python tests/compare.py [sf] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

TABLES = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return sorted(rows, key=repr)


def differences(spark, con, function, sql: str, sf_dir: str) -> str | None:
    """None where both sides agree in names, type families and values."""
    left = function(spark, sf_dir).toArrow()
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} / {sorted(right.column_names)}"
    for name in left.column_names:
        kinds = [_family(t.schema.field(name).type) for t in (left, right)]
        if kinds[0] != kinds[1] and "null" not in kinds:
            return f"type of {name}: {kinds}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(left.column_names)}: {x} / {y}"[:800]
    return None if a else "no rows"


def _family(kind) -> str:
    text = str(kind)
    return {"large_string": "string", "string_view": "string"}.get(text, text)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from triagelake.session import local_session

    sf_dir = os.path.join(TABLES, sys.argv[1] if len(sys.argv) > 1 else "sf0.001")
    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, function, oracles[name], sf_dir)
            else:
                found = f"rows only: {function(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{name:14s} {time.time() - start:6.1f}s {found or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
