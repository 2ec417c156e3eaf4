"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, mixing of sources.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents. A table goes when the one after it is written; the last one, which
the result reads, stays in the checkpoint folder as checkpoints do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm.common import bucket_of, checkpoint_folder, table
from reviewlake.llm.decontaminate import remove_contaminated
from reviewlake.llm.jaccard import keep_one_of_each
from reviewlake.llm.language_id import fit_filter, keep_identified
from reviewlake.llm.mixing import mix_sources
from reviewlake.llm.secret_scan import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or of no known language."""
    return keep_identified(docs, fit_filter(docs.filter(bucket_of("doc_id", 4) != 2).select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one with the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their source's target rate and are shuffled globally."""
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
#: Similarity joins and trained filters have no SQL form.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them are in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
