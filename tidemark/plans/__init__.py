"""Query registry and the end-to-end forecast workflow."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tables", "series", "forecasts", "records")


def _load() -> None:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")


def all_queries():
    _load()
    from tidemark.plans.registry import QUERIES

    return dict(QUERIES)


def all_sql():
    _load()
    from tidemark.plans.registry import SQL

    return dict(SQL)


def flagship(spark, sf):
    return all_queries()["flagship_daily_forecast"](spark, sf)
