"""All registered queries of the market signal engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktide import queries_analysis, queries_core, queries_data, queries_streaming

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbols score 50 or more now."""
    return queries_core.c4_opportunities(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for module in (queries_core, queries_data, queries_analysis, queries_streaming) for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in (queries_core, queries_data, queries_analysis, queries_streaming) for name, (_, sql) in module.QUERIES.items() if sql is not None}
