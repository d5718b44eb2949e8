"""Passing a table's own columns through an operator, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The struct that holds a row as it came, next to an operator's working columns.
ROW = "_doc"


def whole_row() -> Column:
    return F.struct("*").alias(ROW)


def passed(docs: DataFrame, results: Iterable[str] = ()) -> list[Column]:
    """The columns of ``docs`` out of ``ROW``; a result of the same name replaces one."""
    taken = {r.lower() for r in results}
    return [F.col(ROW).getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
