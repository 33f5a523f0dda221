"""Name -> (query, check SQL)."""

from __future__ import annotations

from checks.sql_base import with_parts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, query, needs=None, body=None, recursive=False):
    """Register a query; without ``body`` it has no check SQL."""
    QUERIES[name] = query
    if body is not None:
        ORACLES[name] = with_parts(needs, body, recursive) if needs else body
