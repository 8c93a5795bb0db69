"""All queries that the package registers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.plans import devices, library, mobility, places, scans, study

FLAGSHIP = "watched_commutes"
MODULES = (study, mobility, places, library, scans, devices)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: f for m in MODULES for k, f in m.ORACLE_SQL.items()}
