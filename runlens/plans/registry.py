"""Registry of named queries (op keys) and their DuckDB oracle SQL.

A query is ``(spark, sf_dir) -> DataFrame``: it builds its stand-in input
from the driver tables and applies the library operator.  The oracle is the
same computation written as plain SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate op key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco
