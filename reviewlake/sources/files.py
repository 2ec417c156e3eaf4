"""Sources and sinks (S1-S20): scans of notes, file indices, manifests, and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.sources.records import counted_csv, read_csv

# Fixed value: a layout output of at most this many bytes is empty.
LEAST_LAYOUT_BYTES = 10
MANIFEST = "submission_id string, year int, decision string, pdf_path string, pdf_hash string, pdf_source string, download_id string, title string"


def load_notes(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """Notes written by year; of an id in several years the latest stays."""
    notes = spark.read.parquet(path)
    if years:
        notes = notes.filter(F.col("year").isin(*years))
    return notes.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*notes.columns), F.struct(F.col("year").isNotNull(), F.col("year"))).alias("_note")).select("_note.*")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, modified) of files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def pdf_index(files: DataFrame) -> DataFrame:
    """(year, stem, path) of PDFs in folders of a year."""
    return files.filter("path like '%.pdf'").select(F.regexp_extract("path", r"/(\d{4})/[^/]+$", 1).try_cast("int").alias("year"), F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem"), "path")


def markdown_index(files: DataFrame) -> DataFrame:
    """Folders that hold a markdown file of their own name."""
    stem = F.regexp_extract("path", r"/([^/]+)/\1\.md$", 1)
    return files.select(F.regexp_extract("path", r"/(\d{4})/[^/]+/[^/]+$", 1).try_cast("int").alias("year"), stem.alias("stem"), "path").filter("stem != ''")


def layout_index(files: DataFrame) -> DataFrame:
    """(stem, batch, path) of non-empty layout outputs in batch folders; of a stem in several batches the last batch."""
    rows = files.filter(F.col("length") > LEAST_LAYOUT_BYTES).select(F.regexp_extract("path", r"/(batch_[^/]+)/", 1).alias("batch"), F.regexp_extract("path", r"/batch_[^/]+/([^/]+)/", 1).alias("stem"), "path").filter("stem != ''")
    return rows.groupBy("stem").agg(F.max("batch").alias("batch"), F.max_by("path", "batch").alias("path"))


def image_counts(files: DataFrame) -> DataFrame:
    """Page images of each submission."""
    return files.select(F.regexp_extract("path", r"/([^/]+)/page_\d+\.png$", 1).alias("submission_id")).filter("submission_id != ''").groupBy("submission_id").agg(F.count("*").alias("image_count"))


def load_manifest(spark: SparkSession, path: str | list[str], year: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """A manifest CSV by id, of repeated ids the last row in file order. S9: all rows of a year, if one is asked for."""
    rows = read_csv(spark, path, MANIFEST, split_bytes)
    if year is not None:
        return rows.filter(F.col("year") == year).drop("row_index")
    held = [c for c in rows.columns if c not in ("submission_id", "row_index")]
    return rows.groupBy("submission_id").agg(F.max_by(F.struct(*held), "row_index").alias("_row")).select("submission_id", "_row.*")


def load_completions(spark: SparkSession, glob: str) -> DataFrame:
    """Completion files, rows without JSON dropped."""
    return spark.read.parquet(glob).filter("length(normalized_json) > 0")


def labelled_csvs(spark: SparkSession, paths: dict[str, str], columns: list[str], split_bytes: int | None = None) -> DataFrame:
    """CSVs under labels with their columns, and a running row index over all of them in file order; no row is sorted or moved."""
    out, before = [], 0
    for label, path in paths.items():
        rows, n = counted_csv(spark, path, None, split_bytes)
        out.append(rows.select(*columns, F.lit(label).alias("label"), (F.col("row_index") + before).alias("row_index")))
        before += n.first()["n"]  # one number a label
    return reduce(DataFrame.unionByName, out)


def write_chunks(df: DataFrame, path: str, rows: int = 1000) -> None:
    """Parquet files of at most so many rows; old ones go."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder a value; only folders of values in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def missing_shards(present: DataFrame, shards: int) -> DataFrame:
    """Numbers of shards from 0 that are missing."""
    return present.sparkSession.range(shards).select(F.col("id").alias("shard")).join(present, "shard", "left_anti")


def replace_year(old: DataFrame, new: DataFrame, year: int, order: list[str]) -> DataFrame:
    """The rows of a year replaced, all in order."""
    return old.filter(F.col("year") != year).unionByName(new).orderBy(*order)


def with_contents(rows: DataFrame, path_column: str, contents: DataFrame, name: str) -> DataFrame:
    """The text of each row's file from contents(path, value); empty if there is none."""
    held = contents.select(F.col("path").alias("_path"), F.col("value").alias("_value"))
    return rows.join(held, F.col(path_column) == F.col("_path"), "left").withColumn(name, F.coalesce("_value", F.lit(""))).drop("_path", "_value")
