"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import index_queries, search_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search_queries.QUERIES, **text_queries.QUERIES, **index_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**search_queries.SQL, **text_queries.SQL, **index_queries.SQL}
FLAGSHIP = "bm25_or_top20"
