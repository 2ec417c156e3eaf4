"""Many shards as few files of a bounded size.

Shards, in the order of their paths, are packed into bins by their bytes: the small ones (up to half the bound) by prefix sums,
a bin taking those that begin within half a bound, so that no bin passes the bound and bins are at least a quarter full on
average; larger ones go alone, those over the bound in equal ranges of rows. One task writes one bin. A table of the moves says which
rows of which shard went to which file; shards that are missing are listed, not passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.session import held


def shard_files(spark: SparkSession, root: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the shards under folders; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def pack(shards: DataFrame, bound: int) -> DataFrame:
    """shards(path, length) with their first bin and how many bins they take."""
    big = F.col("length") > bound // 2
    order = Window.orderBy("path")  # one small row a shard
    half = max(1, bound // 2)
    before = F.sum(F.when(big, 0).otherwise(F.col("length"))).over(order) - F.when(big, 0).otherwise(F.col("length"))
    cell = F.when(~big, F.floor(before / half))
    placed = shards.withColumn("_bins", F.when(big, F.ceil(F.col("length") / bound)).otherwise(F.lit(0))).withColumn("_cell", cell)
    # a new bin for each large shard's part, and for each cell at its first small shard
    fresh = F.when(big, F.col("_bins")).otherwise((F.row_number().over(Window.partitionBy("_cell").orderBy("path")) == 1).cast("long"))
    placed = placed.withColumn("_fresh", fresh).withColumn("_upto", F.sum("_fresh").over(order))
    own = F.when(big, F.col("_upto") - F.col("_fresh")).otherwise(F.max(F.when((F.col("_fresh") == 1) & ~big, F.col("_upto") - 1)).over(Window.partitionBy("_cell")))
    return placed.select("path", "length", own.cast("int").alias("bin"), F.greatest(F.lit(1), "_bins").cast("int").alias("bins"))


def _name(path: Column) -> Column:
    """Paths as listings and readers both write them, without the scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/+", "/")


def compact(spark: SparkSession, root: str | list[str], out: str, bound: int = 1 << 30, expected: list[str] | None = None) -> DataFrame:
    """Writes the Parquet shards under root (a folder or several, of one schema) to out, one file a bin, and gives (path, file_bin, first_row, n_rows, bytes, missing).

    Rows keep the order of their shards and their order inside them. expected names folders or files under the first root that should be
    there; those without any shard come back with missing true and no bin."""
    bins = held(pack(shard_files(spark, root), bound))
    n = (bins.agg(F.max(F.col("bin") + F.col("bins"))).first()[0]) or 0
    found = None
    if n:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(*([root] if isinstance(root, str) else root))
        kept = rows.columns
        rows = rows.select("*", _name(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.row_index").alias("_row"))
        sizes = rows.groupBy("_path").agg(F.count("*").alias("_rows"))  # from the files' footers and row numbers alone
        place = held(bins.withColumn("_path", _name(F.col("path"))).join(sizes, "_path", "left").fillna(0, ["_rows"]))
        part = lambda row: F.col("bin") + F.floor(row * F.col("bins") / F.greatest(F.lit(1), F.col("_rows"))).cast("int")
        moved = rows.join(F.broadcast(place.select("_path", "bin", "bins", "_rows")), "_path").withColumn("_bin", part(F.col("_row")))
        moved.repartitionById(int(n), F.col("_bin")).sortWithinPartitions("_path", "_row").select(*kept).write.mode("overwrite").parquet(out)
        cuts = place.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
        edge = lambda k: F.ceil(k * F.col("_rows") / F.col("bins")).cast("long")  # noqa: E731  the first row with floor(row * bins / rows) = k
        found = cuts.select("path", (F.col("bin") + F.col("_part")).alias("file_bin"), edge(F.col("_part")).alias("first_row"), (edge(F.col("_part") + 1) - edge(F.col("_part"))).alias("n_rows"), F.floor(F.col("length") / F.col("bins")).alias("bytes"), F.lit(False).alias("missing"))
    absent = missing(bins, root if isinstance(root, str) else root[0], expected or [])
    return absent if found is None else found.unionByName(absent)


def missing(shards: DataFrame, root: str, expected: list[str]) -> DataFrame:
    """Rows of the table of moves for expected names under root that no shard's path begins with."""
    spark = shards.sparkSession
    names = spark.createDataFrame([(f"{root.rstrip('/')}/{name}",) for name in expected], "path string").withColumn("_want", F.concat(_name(F.col("path")), F.lit("/")))
    cut = F.transform(F.sequence(F.lit(1), F.length("_path")), lambda i: F.when(F.substring("_path", i, F.lit(1)) == "/", F.left("_path", i)))
    there = shards.select(F.concat(_name(F.col("path")), F.lit("/")).alias("_path")).select(F.explode(F.array_compact(cut)).alias("_want")).distinct()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("file_bin", "int"), ("first_row", "long"), ("n_rows", "long"), ("bytes", "long"))]
    return names.join(there, "_want", "left_anti").select("path", *nothing, F.lit(True).alias("missing"))
