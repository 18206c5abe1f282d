"""All registered queries of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.plans import governance_queries, relational_queries, reporting_queries, stream_queries, text_queries

MODULES = (reporting_queries, relational_queries, text_queries, governance_queries, stream_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
