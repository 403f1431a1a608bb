"""Queries of the sequence and interval operators over the given tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regseq.plans import interval_queries, ortholog_queries, record_queries, sequence_queries, statistic_queries

_ALL = interval_queries.QUERIES | ortholog_queries.QUERIES | record_queries.QUERIES | sequence_queries.QUERIES | statistic_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
