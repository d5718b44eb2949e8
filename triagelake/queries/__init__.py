"""Registered queries over the test tables."""

from triagelake.queries.registry import ORACLES, QUERIES


def _load() -> None:
    from triagelake.queries import (  # noqa: F401
        evaluation_queries,
        index_queries,
        rules_queries,
        search_queries,
        stream_queries,
        support_queries,
    )


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from triagelake.queries.sql import select

    _load()
    return {name: select(statement) for name, statement in ORACLES.items()}
