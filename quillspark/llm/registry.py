"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import queries_corpus, queries_pairs, queries_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_text.QUERIES | queries_pairs.QUERIES | queries_corpus.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_text.SQL | queries_pairs.SQL | queries_corpus.SQL
