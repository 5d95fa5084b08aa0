"""All registered queries of the engine, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomatch.plans import decision_queries, document_queries, generation_queries, grid_queries, inventory_queries, review_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return document_queries.QUERIES | review_queries.QUERIES | inventory_queries.QUERIES | decision_queries.QUERIES | generation_queries.QUERIES | grid_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return document_queries.ORACLES | review_queries.ORACLES | inventory_queries.ORACLES | decision_queries.ORACLES | generation_queries.ORACLES | grid_queries.ORACLES
