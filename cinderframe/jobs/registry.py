"""All queries of the wildfire-record library, each with the SQL another engine checks it by."""

from __future__ import annotations

from cinderframe.jobs import file_queries, fire_queries, ground_queries, trail_queries

_MODULES = (fire_queries, file_queries, ground_queries, trail_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
