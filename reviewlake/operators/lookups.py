"""Joins (J1, J5-J9, J12): two-key, latest-before and reply-tree lookups. Prefix and priority lookups (J2-J4) are in prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.text import title_key


def two_key_lookup(rows: DataFrame, papers: DataFrame, row_id: str, row_title: str) -> DataFrame:
    """Citations of papers(id, normalized_title, gs_citation) by id, else by title; a negative result is null, also if the title had one."""
    by_id = papers.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(F.max_by("gs_citation", F.coalesce("pos", F.lit(0))).alias("_c1"))
    by_title = papers.filter("normalized_title is not null").groupBy(F.col("normalized_title").alias("_t")).agg(F.max_by("gs_citation", F.coalesce("pos", F.lit(0))).alias("_c2"))
    found = rows.join(by_id, F.col(row_id) == F.col("_id"), "left").join(by_title, title_key(F.col(row_title)) == F.col("_t"), "left")
    c = F.coalesce("_c1", "_c2")
    return found.withColumn("gs_citation", F.when(c >= 0, c)).drop("_id", "_t", "_c1", "_c2")


def latest_before(rows: DataFrame, key: str, ts: str, pos: str, value: Column, cutoff: Column) -> DataFrame:
    """Of each key the value of its latest row with ts before the cutoff; ties to the later position. Partial aggregation, no sort."""
    return rows.filter(F.col(ts) < cutoff).groupBy(key).agg(F.max_by(value, F.struct(ts, pos)).alias("latest"))


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides whose value differs (null counts as a value)."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    return a.join(b, key).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys done lacks."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def reply_counts(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Of each review(id, forum, reviewer) the author answers to it (distinct) and the same reviewer's answers to those.

    comments(id, forum, replyto, signatures STRING). A reviewer's name counts where the signatures contain it.
    """
    authors = comments.filter(F.contains("signatures", F.lit("Authors"))).select(F.col("id").alias("a_id"), F.col("replyto").alias("a_to"), F.col("forum").alias("a_forum"))
    first = reviews.join(authors, (F.col("id") == F.col("a_to")) & (F.col("forum") == F.col("a_forum")), "left")
    back = comments.select(F.col("id").alias("r_id"), F.col("replyto").alias("r_to"), F.col("signatures").alias("r_sig"), F.col("forum").alias("r_forum"))
    second = first.dropDuplicates(["id", "a_id"]).join(back, (F.col("a_id") == F.col("r_to")) & (F.col("forum") == F.col("r_forum")) & F.contains(F.col("r_sig"), F.col("reviewer")), "left")
    return second.groupBy("forum", "id").agg(F.count_distinct("a_id").alias("author_replies"), F.count("r_id").alias("reviewer_replies"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """U4: one row a key, the last in order, by partial aggregation."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_row")).select("_row.*")


def latest_revision(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, by partial aggregation."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def revision_numbers(rows: DataFrame, key: str, ts: str, pos: str, name: str = "revision") -> DataFrame:
    """The rows of each key numbered from 1 by time (none counts as 0), then position."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce(F.col(ts), F.lit(0).cast(rows.schema[ts].dataType)), pos)))


def only_known(rows: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key is in the other table."""
    return rows.join(known.select(F.col(known_key).alias("_known")), F.col(key) == F.col("_known"), "left_semi")


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str, *columns: str) -> DataFrame:
    """Columns of a dimension, of which each key has at most one row; null where it lacks the key."""
    held = dimension.select(F.col(dimension_key).alias("_key"), *columns)
    return rows.join(held, F.col(key) == F.col("_key"), "left").drop("_key")


def key_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of all distinct keys of two tables: both, left or right."""
    held = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s"))).groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return held.select(key, F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("_s")).alias("side"))
