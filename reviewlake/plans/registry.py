"""Where query modules register their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register fn(load) -> DataFrame as a query; load(name) reads a table."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap
