"""Rows that fail as data (E4, E9): every row comes out once, as a result or as (stage, error), and both are written in one pass.

A stage is a column expression that gives a fault (null if the row is fine), or a Python function run by attempt(), whose exceptions
become texts. What fails in a stage isn't tried in the next ones, and a broken row never fails the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

GOOD, FAILED = "good", "failed"


def attempt(function: Callable, returns: str, *columns: Column, when: Column | None = None) -> Column:
    """struct<value, error>: the function of the columns' values, row by row in Arrow batches; the error as its type and text. Where
    when is given, other rows aren't tried (both null)."""

    def run(*series: pd.Series) -> pd.DataFrame:
        out = []
        for tried, *values in zip(*series):
            try:
                out.append((function(*values), None) if tried else (None, None))
            except Exception as e:  # any fault of a row is its result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return F.pandas_udf(run, f"value {returns}, error string")(F.coalesce(when, F.lit(False)) if when is not None else F.lit(True), *columns)


def with_outcome(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """rows with stage and error of the first check that has one, and the outcome good or failed."""
    first = F.coalesce(*[F.when(error.isNotNull(), F.struct(F.lit(stage).alias("stage"), error.cast("string").alias("error"))) for stage, error in checks])
    held = rows.withColumn("_first", first)
    return held.select(*rows.columns, F.col("_first.stage").alias("stage"), F.col("_first.error").alias("error"), F.when(F.col("_first").isNull(), GOOD).otherwise(FAILED).alias("outcome"))


def write_both(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes rows of with_outcome() to the folders of their outcome under path, in one pass; how many there are of each, counted in that pass."""
    seen = Observation(f"outcomes-{uuid.uuid4()}")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in (GOOD, FAILED)]
    rows.observe(seen, *counts).write.mode("overwrite").partitionBy("outcome").parquet(path)
    return {o: seen.get[o] for o in (GOOD, FAILED)}


def read_outcome(spark: SparkSession, path: str, outcome: str, like: DataFrame) -> DataFrame:
    """The rows of one outcome; like gives the columns, as a folder may be absent."""
    kept = like.drop("outcome")
    return spark.read.schema(like.schema).parquet(path).filter(F.col("outcome") == outcome).select(*kept.columns)
