"""The first stem that begins with an id, as a search in sorted ranges.

The first stem in order that begins with an id is the first one at or after the id, if that begins with it. So distinct ids and
stems are laid out together in ranges of (part, text), each once, and every range is read downwards with the last stem seen
of each priority in hand. What a range starts with is the least stem of the ranges above it: one row a range and priority.
Work is one sort of ids and stems, however many stems an id begins and however alike they begin; a range is bounded by
Spark's sampling, as repeated ids and stems are merged before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.session import held


def first_with_prefix(asked: DataFrame, stems: DataFrame) -> DataFrame:
    """(_g, _k, stem, path) of asked(_g, _k, _begin) that have a stem of stems(_g, stem, priority, path) in their part _g that begins with
    _begin: least priority first, then stem, then path. Rows with nulls in _g, _begin or stem find and are nothing."""
    kind = dict(stems.dtypes)["_g"]
    ids = asked.filter("_g is not null and _begin is not null").select("_g", F.col("_begin").alias("_text"), F.lit(1).alias("_side"), "_k", *(F.lit(None).cast(t).alias(c) for c, t in (("priority", "int"), ("path", "string")))).distinct()
    ranked = stems.filter("_g is not null and stem is not null").groupBy("_g", F.col("stem").alias("_text"), F.col("priority").cast("int").alias("priority")).agg(F.min("path").alias("path"))
    both = ids.unionByName(ranked.select("_g", "_text", F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_k"), "priority", "path"))
    # downwards, a stem before the ids that equal it
    ranges = held(both.repartitionByRange("_g", "_text").sortWithinPartitions(F.desc("_g"), F.desc("_text"), "_side").withColumn("_range", F.spark_partition_id()))
    least = ranges.filter("_side = 0").groupBy("_range", F.coalesce("priority", F.lit(-1)).alias("_p")).agg(F.min(F.struct("_g", "_text", "path")).alias("_least"))
    spots = ranges.select("_range").distinct().crossJoin(F.broadcast(least.select("_p").distinct()))  # one row a range and priority
    above = Window.partitionBy("_p").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    carried: dict[int, dict[int, tuple]] = {}
    for row in spots.join(least, ["_range", "_p"], "left").withColumn("_above", F.min("_least").over(above)).filter("_above is not null").collect():
        carried.setdefault(row["_range"], {})[row["_p"]] = tuple(row["_above"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, {}
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            for at, g, text, side, k, priority, path in zip(*(rows[c] for c in ("_range", "_g", "_text", "_side", "_k", "priority", "path"))):
                if at != now:
                    now, seen = at, dict(carried.get(at, {}))
                if side == 0:
                    seen[-1 if priority is None else priority] = (g, text, path)
                    continue
                for p in sorted(seen):
                    if seen[p][0] == g and seen[p][1].startswith(text):
                        out.append((g, k, *seen[p][1:]))
                        break
            if out:
                g, *cells = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(g, batch.column("_g").type), *(pa.array(x, pa.string()) for x in cells)], ["_g", "_k", "stem", "path"])

    return ranges.mapInArrow(read, f"_g {kind}, _k string, stem string, path string")


def prefix_lookup(ids: DataFrame, index: DataFrame, key: str = "id", stem: str = "stem", part: str = "year", delimiter: str | None = None) -> DataFrame:
    """The first stem in order that starts with the id (or is it, or goes on with the delimiter), within the part."""
    stems = index.select(F.col(part).alias("_g"), F.col(stem).alias("stem"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("path"))
    asked = ids.select(F.col(part).alias("_g"), F.col(key).alias("_k")).distinct()
    begin = F.col("_k") if delimiter is None else F.concat("_k", F.lit(delimiter))
    found = first_with_prefix(asked.withColumn("_begin", begin), stems).select("_g", "_k", "stem")
    if delimiter is not None:  # a stem that is the id comes before all that go on
        same = asked.join(stems.select(F.col("_g").alias("_h"), "stem").distinct(), (F.col("_g") == F.col("_h")) & (F.col("_k") == F.col("stem"))).select("_g", "_k", "stem")
        found = found.unionByName(same).groupBy("_g", "_k").agg(F.min("stem").alias("stem"))
    found = found.withColumnRenamed("stem", "_stem")
    return ids.join(found, (F.col(part) == F.col("_g")) & (F.col(key) == F.col("_k")), "left").select(*ids.columns, F.col("_stem").alias(stem))


def priority_lookup(ids: DataFrame, index: DataFrame, key: str = "id", part: str = "year") -> DataFrame:
    """Like prefix_lookup over index(year, stem, priority, path): least priority first, then stem."""
    stems = index.select(F.col(part).alias("_g"), "stem", "priority", "path")
    asked = ids.select(F.col(part).alias("_g"), F.col(key).alias("_k")).distinct()
    found = first_with_prefix(asked.withColumn("_begin", F.col("_k")), stems).select("_g", "_k", F.col("stem").alias("_stem"), F.col("path").alias("_path"))
    return ids.join(found, (F.col(part) == F.col("_g")) & (F.col(key) == F.col("_k")), "left").select(*ids.columns, F.col("_stem").alias("stem"), F.col("_path").alias("path"))
