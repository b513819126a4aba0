"""The registry of queries: a key, a function of (spark, sf_dir), and DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import base_table, fixture, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The tables a query may read: ``t.fx_reads``, ``t.lineitem``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return fixture(self.spark, self.sf_dir, name)
        return base_table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    """Register a function of ``Inputs`` under ``name``; ``sql`` is its oracle."""

    def register(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register
