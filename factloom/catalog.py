"""All queries of the fact engine, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, audits, bindings, evaluation, filings, gates, graphs, production, roles, statistics, texts

_PARTS = (analytics, audits, bindings, roles, evaluation, filings, gates, graphs, production, statistics, texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.R.sql.items()}
