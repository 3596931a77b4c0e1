"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_queries, index_queries, ingest_queries, retrieval_queries, source_queries

_PARTS = [ingest_queries, retrieval_queries, index_queries, source_queries, context_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
