"""All queries of the change-data engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rivulet.session import shipping

MODULES = ("dedup", "ordered", "transport", "rules", "status", "text", "stream", "misc", "delivery", "apply", "log", "capture")


def _parts():
    return [import_module(f"rivulet.queries_{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipping(query) for part in _parts() for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.ORACLE_SQL.items()}
