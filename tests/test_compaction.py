"""Shards packed by size: bounds, order, moves and missing shards."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reviewlake.sources import compaction as C


def test_pack(spark):
    sizes = [10, 20, 30, 200, 5, 60, 45, 0, 51, 7, 100, 9]
    shards = spark.createDataFrame([(f"/s/{i:02d}", n) for i, n in enumerate(sizes)], "path string, length long")
    got = sorted(map(tuple, C.pack(shards, 100).collect()))
    held = {}
    for _, n, first, bins in got:
        assert bins == (max(1, -(-n // 100)) if n > 50 else 1)
        for k in range(first, first + bins):
            held.setdefault(k, []).append(n / bins)
    assert sorted(held) == list(range(len(held))) and all(sum(x) <= 100 for x in held.values())
    assert len(held) <= 2 * -(-sum(sizes) // 100) + 2 and C.pack(shards.limit(0), 100).count() == 0


def test_compact_keeps_rows_and_order(spark, tmp_path):
    rows = spark.range(20_000).withColumn("text", F.md5(F.col("id").cast("string")))
    for i, (lo, hi) in enumerate([(0, 500), (500, 700), (700, 15_000), (15_000, 15_000), (15_000, 20_000)]):
        rows.filter(F.col("id").between(lo, hi - 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"shard_{i:02d}"))
    bound = 250_000
    moves = C.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), bound, [f"shard_{i:02d}" for i in range(6)]).collect()
    assert [m["path"].rpartition("/")[2] for m in moves if m["missing"]] == ["shard_05"]
    files = sorted((tmp_path / "out").glob("*.parquet"))
    ids = [pq.read_table(f).column("id").to_pylist() for f in files]
    assert [i for part in ids for i in part] == list(range(20_000)) and len(files) > 4  # one file a bin, in order
    told = {}
    for m in moves:
        if m["n_rows"]:
            told[m["file_bin"]] = told.get(m["file_bin"], 0) + m["n_rows"]
    assert [told[k] for k in sorted(told)] == [len(part) for part in ids if part]
    assert all(f.stat().st_size <= 1.3 * bound for f in files)
    empty = C.compact(spark, str(tmp_path / "in" / "shard_03"), str(tmp_path / "none"), bound)
    assert [m["n_rows"] for m in empty.collect()] in ([0], [])
