"""Registry of the core queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexweave.plans import books, books_sql, drift, reports, reports_sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return books.QUERIES | reports.QUERIES | drift.QUERIES


def oracle_sql() -> dict[str, str]:
    return books_sql.ORACLES | reports_sql.ORACLES
