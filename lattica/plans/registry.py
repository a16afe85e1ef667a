"""Registry of the engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("expression", "curation", "graphs", "texts", "models", "inputs", "choices"):
    _module = import_module(f"lattica.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
