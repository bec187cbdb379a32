"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import queries_adapters, queries_nested, queries_orphans, queries_records, queries_search, queries_sql

MODULES = (queries_adapters, queries_nested, queries_orphans, queries_search, queries_records, queries_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors among the documents that satisfy a keyword query."""
    return queries_search.vector_topk_filtered(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


SQL_NAMES = frozenset(oracle_sql())
