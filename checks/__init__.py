"""Registered queries and their check SQL, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["extraction", "documents", "relations", "graphs", "rollups", "upkeep"]


def _load():
    for area in AREAS:
        import_module(f"checks.{area}")
    from checks import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
