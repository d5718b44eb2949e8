"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest
from compare import TABLES, connect, differences

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from triagelake.queries import all_oracles, all_queries  # noqa: E402

SF_DIR = os.path.join(TABLES, os.environ.get("TEST_SF", "sf0.001"))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    found = differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert found is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
