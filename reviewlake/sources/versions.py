"""Tables whose parts are replaced at once.

A part (the rows of one value of a column) is written to a folder of its own first. Then a commit, a small file that lists the
folder of every part, is created under the next number; creating fails if another writer took that number, who then has to be read
again. Readers follow the last commit, so they see either the old rows or the new ones, and a write that fails leaves the old.
Nothing but the replaced part is written. Folders that no commit of the last ones names can be removed by expire().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first."""


def _files(spark: SparkSession, path: str):
    """Hadoop's path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, store = _files(spark, f"{root}/commits")
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def last_commit(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The last commit's number (0 without one) and the folder of each part."""
    numbers = _numbers(spark, root)
    if not numbers:
        return 0, {}
    text = spark.read.option("wholetext", "true").text(f"{root}/commits/{numbers[-1]:012d}.json").first()[0]
    return numbers[-1], json.loads(text)


def _commit(spark: SparkSession, root: str, number: int, parts: dict[str, str]) -> None:
    at, store = _files(spark, f"{root}/commits/{number:012d}.json")
    staged, _ = _files(spark, f"{root}/staged-{uuid.uuid4()}.json")
    out = store.create(staged, False)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    store.mkdirs(at.getParent())
    if store.exists(at) or not store.rename(staged, at):
        store.delete(staged, False)
        raise Conflict(f"commit {number} of {root} is another writer's")


def replace_parts(df: DataFrame, root: str, column: str, values: list | None = None) -> int:
    """The parts of the given values (else of those in df) become df's rows of them; the new commit's number. A value without rows goes."""
    spark = df.sparkSession
    number, parts = last_commit(spark, root)
    folder = f"data/{uuid.uuid4()}"
    rows = df if values is None else df.filter(F.col(column).isin(values))
    rows.withColumn("_part", F.col(column)).repartition(column).write.partitionBy("_part").parquet(f"{root}/{folder}")
    at, store = _files(spark, f"{root}/{folder}")
    written = {f.getPath().getName().partition("=")[2]: f"{folder}/{f.getPath().getName()}" for f in store.listStatus(at) if f.isDirectory() and not f.getPath().getName().startswith(("_temporary", "."))}
    gone = {str(v) for v in values or []}
    _commit(spark, root, number + 1, {k: v for k, v in {**parts, **written}.items() if k in written or k not in gone})
    return number + 1


def read_parts(spark: SparkSession, root: str, schema: str, values: list | None = None, number: int | None = None) -> DataFrame:
    """The rows of the last commit (or of an earlier one), of some parts if asked: other parts' files aren't listed."""
    if number is None:
        _, parts = last_commit(spark, root)
    else:
        parts = json.loads(spark.read.option("wholetext", "true").text(f"{root}/commits/{number:012d}.json").first()[0])
    wanted = [folder for value, folder in sorted(parts.items()) if values is None or value in {str(v) for v in values}]
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in wanted]) if wanted else spark.createDataFrame([], schema)


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes the commits before the last ones, and folders that none of those names; how many folders went."""
    numbers = _numbers(spark, root)
    named: set[str] = set()
    for n in numbers[-keep:]:
        named |= set(json.loads(spark.read.option("wholetext", "true").text(f"{root}/commits/{n:012d}.json").first()[0]).values())
    for n in numbers[:-keep]:
        at, store = _files(spark, f"{root}/commits/{n:012d}.json")
        store.delete(at, False)
    at, store = _files(spark, f"{root}/data")
    gone = 0
    for write in store.listStatus(at) if store.exists(at) else ():
        for part in store.listStatus(write.getPath()):
            if part.isDirectory() and f"data/{write.getPath().getName()}/{part.getPath().getName()}" not in named:
                store.delete(part.getPath(), True)
                gone += 1
    return gone
