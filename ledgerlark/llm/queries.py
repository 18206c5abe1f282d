"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import (
    decontamination,
    grid_join,
    jaccard_join,
    language_id,
    merkle_manifest,
    mixing,
    quality_classifier,
    quality_rules,
    repeated_spans,
    sharding,
    spelling_variants,
    url_reputation,
    warc,
)

MODULES = (
    url_reputation,
    quality_rules,
    jaccard_join,
    quality_classifier,
    decontamination,
    sharding,
    language_id,
    mixing,
    warc,
    repeated_spans,
    merkle_manifest,
    grid_join,
    spelling_variants,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
