"""Registry of the query catalogue.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` reading the
driver tables; ``sql`` is the equivalent DuckDB text over the same tables
(``None`` where the operator is iterative or model-based and is checked by
tests instead).  Column names and types agree on both sides: counts are
BIGINT, measures DOUBLE rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordlab.sources.tables import table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)
