"""Funnels, coverage and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, group: str, stages: dict[str, Column]) -> DataFrame:
    """A1: of each group, and in total (group null), how many rows pass each stage and all stages before it. One aggregation."""
    passed, counts = F.lit(True), [F.count("*").alias("total")]
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.rollup(group).agg(*counts)


def flag_counts(rows: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """Rows of each group, and in total, for which each condition holds."""
    return rows.rollup(group).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def subset_cells(rows: DataFrame, flags: dict[str, Column], by: list[str], key: str) -> DataFrame:
    """Count and first key of every combination of conditions, by other columns; no condition is none."""
    name = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()])), "+")
    return rows.withColumn("subset", F.coalesce(F.nullif(name, F.lit("")), F.lit("none"))).groupBy(*by, "subset").agg(F.count("*").alias("n"), F.min(key).alias("example"))


def first_label(rows: DataFrame, key: str, label: str, index: str) -> DataFrame:
    """Of each key the label of its first row, and that row's index."""
    return rows.groupBy(key).agg(F.min_by(label, index).alias("label"), F.min(index).alias("first_index"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of each combination of values."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def key_presence(rows: DataFrame, group: str, keys: Column) -> DataFrame:
    """For every key in an array of keys, in how many groups it occurs, the first and last, and whether in all."""
    n_groups = rows.select(group).distinct().count()
    each = rows.select(group, F.explode(keys).alias("key")).distinct()
    return each.groupBy("key").agg(F.count("*").alias("n_groups"), F.min(group).alias("first_group"), F.max(group).alias("last_group")).withColumn("in_all", F.col("n_groups") == n_groups)


def dropped_examples(rows: DataFrame, group: str, key: str, reason: Column, n: int) -> DataFrame:
    """The first n dropped rows of each group with the reason."""
    w = Window.partitionBy(group).orderBy(key)
    return rows.withColumn("reason", reason).filter("reason is not null").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(group, key, "reason")


def child_averages(parents: DataFrame, children: DataFrame, key: str, parent_key: str, group: str) -> DataFrame:
    """A2, A10: (group, papers, reviews, average): children in all and on average by a column of their parents, from per-parent counts."""
    per = children.groupBy(F.col(parent_key).alias("_parent")).agg(F.count("*").alias("_k"))
    rows = parents.join(per, F.col(key) == F.col("_parent"))
    return rows.groupBy(group).agg(F.count("*").alias("papers"), F.sum("_k").alias("reviews")).withColumn("average", F.col("reviews") / F.col("papers"))


def distinct_values(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, values, n): the distinct values that are there, in order, and how many."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(column)).alias("values"), F.count_distinct(column).alias("n"))


def success_rate(rows: DataFrame, group: str, passed: Column) -> DataFrame:
    """Share of rows of each group that pass, in percent."""
    return rows.groupBy(group).agg(F.avg(F.when(passed, 100.0).otherwise(0.0)).alias("rate"))


def validation_counts(rows: DataFrame, group: str, key: str, checks: dict[str, Column], examples: int = 100) -> DataFrame:
    """Rows of each group, how many pass each check, and the first keys that fail the first one (a sample, in order)."""
    first = F.coalesce(next(iter(checks.values())), F.lit(False))
    counts = rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    failed = dropped_examples(rows, group, key, F.when(~first, F.lit("missing")), examples).groupBy(F.col(group).alias("_g")).agg(F.sort_array(F.collect_list(key)).alias("missing"))
    return counts.join(failed, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """O1, O2: the n most frequent values, ties in order."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
