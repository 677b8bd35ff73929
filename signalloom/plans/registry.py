"""Every query of the core by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import landed_queries, signal_queries, stream_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = table_queries.QUERIES | text_queries.QUERIES | signal_queries.QUERIES | landed_queries.QUERIES | stream_queries.QUERIES
ORACLE: dict[str, str] = table_queries.ORACLE | text_queries.ORACLE | signal_queries.ORACLE | landed_queries.ORACLE | stream_queries.ORACLE
