"""Registered queries of the core and the SQL that states the same."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.registry import ORACLE, QUERIES

for _m in ("text", "layout", "retrieval", "routing", "memory", "resilience", "joins", "models", "values", "sinks", "streams"):
    importlib.import_module(f"foliant.plans.{_m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
