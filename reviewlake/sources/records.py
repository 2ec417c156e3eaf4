"""Delimited files read by splits whatever their fields hold, with a running index in file order.

A quoted field may hold line ends, so a line of a split needn't begin a record. Each split is therefore read under both
assumptions, that it begins outside or inside a quoted field: its number of quotes, how many records begin in it, the lines
before the first of them and its last record. Prefix sums of the quotes over a file's splits (one small row each) tell which
assumption holds, and prefix sums of the counts give every record its place in file order. A second pass cuts each split's
records; those that cross splits are put together from the first pass, which also gives headers and counts. A task takes many
splits where they are small. No file, however large, is one task's, and no data are shuffled but for records that cross splits.

Files are in the order of their paths. Blank lines outside quoted fields are no records. Quotes stand only around fields
and doubled inside them, as writers of such files have it; a file that ends inside a quoted field gives that field as far as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.session import held

#: Splits up to which their table of states (a few numbers and a path each) is broadcast; beyond, lines are shuffled by split.
BROADCAST_SPLITS = 100_000
#: Bytes of small splits that one task reads.
TASK_BYTES = 32 << 20
#: What the parser gives for a quoted empty field, as opposed to a missing one.
_EMPTY = "\ufdd0"
PARSE = {"escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n", "maxCharsPerColumn": "-1", "maxColumns": "100000", "emptyValue": _EMPTY, "mode": "PERMISSIVE"}
SPLIT = "file string, block long, odd int, starts_outside long, starts_inside long, head string, last_outside string, last_inside string, first string"
RECORD = "file string, block long, nth long, record string"


def file_lines(spark: SparkSession, paths: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """(file, block, line) of text files, in order within each split; split_bytes overrides the session's size of splits."""
    if split_bytes is not None:
        parallelism = spark.sparkContext.defaultParallelism
        spark = spark.newSession()
        for key, value in (("maxPartitionBytes", split_bytes), ("openCostInBytes", 0)):
            spark.conf.set(f"spark.sql.files.{key}", str(value))
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    if split_bytes is None or split_bytes >= TASK_BYTES:
        return lines
    splits = lines.rdd.getNumPartitions()
    return lines.coalesce(max(1, min(splits, max(parallelism, -(-splits * split_bytes // TASK_BYTES)))))


class _Split:
    """A split's lines so far, read from one state: outside (0) or inside (1) a quoted field."""

    def __init__(self, state: int):
        self.state = state
        self.starts = 0
        self.head: list[str] = []  # lines before the first record
        self.last: list[str] = []  # the record begun last
        self.first: list[str] = []  # the first record, if another one begins after it

    def add(self, lines: list[str], odd: np.ndarray, blank: np.ndarray, whole: list[str] | None = None) -> None:
        """Records that end here go to whole, if given."""
        before = (self.state + np.cumsum(odd) - odd) % 2
        begins = np.flatnonzero((before == 0) & ~blank)
        skipped = (before == 0) & blank  # between records
        at = 0
        for to in [*begins.tolist(), len(lines)]:
            part = [x for x, skip in zip(lines[at:to], skipped[at:to].tolist()) if not skip] if skipped[at:to].any() else lines[at:to]
            (self.last if self.starts else self.head).extend(part)
            if to < len(lines):
                if self.starts == 1:
                    self.first = self.last
                if self.starts and whole is not None:
                    whole.append("\n".join(self.last))
                self.starts += 1
                self.last = []
            at = to
        self.state = int((self.state + odd.sum()) % 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, bool]]:
    """Stretches of lines of one split, and whether the split is a new one."""
    now = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        lines = batch.column("line").to_pylist()
        edge = [0, *[i for i in range(1, len(lines)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(lines)]
        for i, j in zip(edge, edge[1:]):
            if i < j:
                split, new = (files[i], int(blocks[i])), (files[i], int(blocks[i])) != now
                now = split
                part = lines[i:j]
                yield split, {"lines": part, "odd": np.fromiter((x.count('"') & 1 for x in part), np.int64, j - i), "blank": np.fromiter((x in ("", "\r") for x in part), bool, j - i), "first": batch.slice(i, 1)}, new


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split, read under both assumptions."""
    split, both, odd = None, (), 0
    names = [c.split()[0] for c in SPLIT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def out() -> pa.RecordBatch:
        text = lambda lines: "\n".join(lines) if lines else None
        row = [*split, odd % 2, both[0].starts, both[1].starts, text(both[1].head), text(both[0].last), text(both[1].last), text(both[0].first)]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    for at, run, new in _runs(batches):
        if new:
            if split:
                yield out()
            split, both, odd = at, (_Split(0), _Split(1)), 0
        for one in both:
            one.add(run["lines"], run["odd"], run["blank"])
        odd += int(run["odd"].sum())
    if split:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split but its last; nth counts from the split's first."""
    at, one, n = None, _Split(0), 0
    for split, run, new in _runs(batches):
        if new:
            at, one, n = split, _Split(run["first"].column("state")[0].as_py()), 0
        whole: list[str] = []
        one.add(run["lines"], run["odd"], run["blank"], whole)
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(whole)), pa.array([at[1]] * len(whole), pa.int64()), pa.array(range(n, n + len(whole)), pa.int64()), pa.array(whole, pa.string())], ["file", "block", "nth", "record"])
            n += len(whole)


def _bare(record: str) -> Column:
    return F.when(F.endswith(record, F.lit("\r")), F.expr(f"left({record}, length({record}) - 1)")).otherwise(F.col(record)).alias("record")


def _scan(spark: SparkSession, paths: str | list[str], header: bool, split_bytes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file, row_index, record) of all records; (record) of the headers; and one row of how many other records there are. The last
    two come from the splits' states alone."""
    lines = file_lines(spark, paths, split_bytes)
    found = held(lines.mapInArrow(_survey, SPLIT))
    in_file, in_all = Window.partitionBy("file").orderBy("block"), Window.orderBy("file", "block")  # one small row a split
    states = found.drop("head", "last_outside", "last_inside", "first").withColumn("state", (F.sum("odd").over(in_file) - F.col("odd")) % 2)
    states = states.withColumn("starts", F.when(F.col("state") == 0, F.col("starts_outside")).otherwise(F.col("starts_inside")))
    states = states.withColumn("in_file", F.sum("starts").over(in_file) - F.col("starts"))
    states = states.withColumn("headed", ((F.col("in_file") == 0) & (F.col("starts") > 0) & F.lit(header)).cast("long"))
    # place of the split's first record among all, less the headers before it and its own
    states = held(states.withColumn("place", F.sum("starts").over(in_all) - F.col("starts") - F.sum("headed").over(in_all)).select("file", "block", "state", "starts", "in_file", "headed", "place"))
    small = found.count() <= BROADCAST_SPLITS
    if small:
        states = states.coalesce(1)
        with_state = lines.join(F.broadcast(states.select("file", "block", "state")), ["file", "block"])
    else:
        with_state = lines.withColumn("_order", F.monotonically_increasing_id()).join(states.select("file", "block", "state"), ["file", "block"])
        with_state = with_state.repartition("file", "block").sortWithinPartitions("file", "block", "_order").drop("_order")
    side = F.broadcast(states) if small else states
    index = F.when((F.col("headed") == 0) | (F.col("nth") > 0), F.col("place") + F.col("nth")).alias("row_index")
    inner = with_state.mapInArrow(_cut, RECORD).join(side, ["file", "block"]).select("file", index, "record")
    # the last record of each split, and what the next ones add to it: it is the record in_file + starts - 1 of its file
    parts = found.select("file", "block", "head", "last_outside", "last_inside").join(states, ["file", "block"])
    last = parts.filter("starts > 0").select("file", (F.col("in_file") + F.col("starts") - 1).alias("_record"), "block", F.lit(0).alias("_side"), F.when(F.col("state") == 0, F.col("last_outside")).otherwise(F.col("last_inside")).alias("text"), (F.col("starts") - 1).alias("nth"), "headed", "place")
    more = parts.filter("state = 1 and head is not null").select("file", (F.col("in_file") - 1).alias("_record"), "block", F.lit(1).alias("_side"), F.col("head").alias("text"), *(F.lit(None).cast("long").alias(c) for c in ("nth", "headed", "place")))
    crossing = last.unionByName(more).groupBy("file", "_record").agg(*(F.max(c).alias(c) for c in ("nth", "headed", "place")), F.array_sort(F.collect_list(F.struct("block", F.negative("_side").alias("_s"), "text"))).alias("_texts"))
    # of one split the head comes first: it ends a record before the split's own begin
    crossing = crossing.select("file", index, F.concat_ws("\n", F.col("_texts.text")).alias("record"))
    # the first record of a file begins outside a quoted field, as no record before it opened one
    headers = found.select("file", "block", "first").join(side.filter("headed = 1 and starts > 1"), ["file", "block"]).select(_bare("first"))
    headers = headers.union(crossing.filter("row_index is null").select(_bare("record")))
    return inner.unionByName(crossing).select("file", "row_index", _bare("record")), headers, states.agg(F.coalesce(F.sum(F.col("starts") - F.col("headed")), F.lit(0)).alias("n"))


def read_records(spark: SparkSession, paths: str | list[str], header: bool = True, split_bytes: int | None = None) -> DataFrame:
    """(file, row_index, record) of all records of the files, row_index from 0 in file order; a header's is null."""
    return _scan(spark, paths, header, split_bytes)[0]


def header_of(headers: DataFrame) -> list[str]:
    """The column names that all files share."""
    fields = [tuple(r.names) for r in headers.select(F.regexp_replace("record", "^\ufeff", "").alias("record")).distinct().select(F.from_csv("record", ", ".join(f"c{i} string" for i in range(1000)), PARSE).alias("c")).select(F.filter(F.array("c.*"), lambda x: x.isNotNull()).alias("names")).collect()]
    if len(fields) > 1:
        raise ValueError(f"files with different headers: {sorted(fields)}")
    return list(fields[0]) if fields else []


def counted_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What read_csv gives, and one row of how many rows it has, for which no record is read again."""
    records, headers, n = _scan(spark, paths, True, split_bytes)
    if schema is None:
        schema = ", ".join(f"`{name}` string" for name in header_of(headers))
    rows = records.filter("row_index is not null").select("row_index", F.from_csv("record", schema or "`_` string", PARSE).alias("_row")).select("row_index", "_row.*")
    return rows.select(*[F.when(F.col(f"`{c}`") != _EMPTY, F.col(f"`{c}`")).when(F.col(f"`{c}`").isNotNull(), "").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes if c != "row_index"], "row_index"), n


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """The columns of delimited files with a header, and row_index. schema names the columns by place; without it they are the
    header's, as strings. Missing fields are null, quoted empty ones empty."""
    return counted_csv(spark, paths, schema, split_bytes)[0]
