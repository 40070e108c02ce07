"""Every query over the supplied tables, with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.queries import quality_queries, stream_queries, table_queries, vault_queries

_MODULES = (vault_queries, quality_queries, stream_queries, table_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault_queries.revenue_by_priority(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
