"""Queries over the given tables, one or more per operator, with their check SQL."""

from __future__ import annotations

from importlib import import_module

from vacantia.catalog.registry import ORACLES, QUERIES, Query

AREAS = ("texts", "labels", "maintenance", "searching", "joining", "counting", "scoring", "forms",
         "evidence", "resumes", "tracking", "streams")


def _load() -> None:
    for area in AREAS:
        import_module(f"vacantia.catalog.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
