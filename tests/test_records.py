"""Delimited files read by small splits against Python's csv module."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import files as IO
from reviewlake.sources import outputs as O
from reviewlake.sources import records as R

BITS = ['"', "\n", "a", ",", "b c", " ", "\r", "\r\n", "é𝄞", "\\", "x" * 90, '""', "\t"]


def rows_of(n):
    rng = random.Random(3)
    return [(i, None if i % 17 == 5 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))), rng.choice(["", None, "q", "\n"])) for i in range(n)]


@pytest.mark.parametrize("broadcast", [R.BROADCAST_SPLITS, 0])
def test_round_trip_of_every_character(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(R, "BROADCAST_SPLITS", broadcast)
    rows = rows_of(120)
    df = spark.createDataFrame(rows, "id int, t string, u string")
    O.write_csv(df.repartitionByRange(2, "id").sortWithinPartitions("id"), str(tmp_path / "a"))
    got = R.read_csv(spark, str(tmp_path / "a"), "id int, t string, u string", 500)
    assert sorted(map(tuple, got.collect())) == [(*r, i) for i, r in enumerate(rows)]  # nulls, empty texts and the order of files stay


@pytest.mark.parametrize("size", [90, 1 << 20])
def test_files_of_another_writer(spark, tmp_path, size):
    rows = [(i, t or "") for i, t, _ in rows_of(60)] + [(60, "one very long\n" * 40)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f)  # \r\n ends its records
        out.writerow(["id", "the text"])
        out.writerows(rows[:40])
        f.write("\r\n\r\n")
        out.writerows(rows[40:])
    with open(tmp_path / "b.csv", "w", newline="") as f:
        f.write('﻿id,the text\n\n9,"not closed\nat the end')
    (tmp_path / "c.csv").write_text("")
    got = R.read_csv(spark, [str(tmp_path / x) for x in ("b.csv", "c.csv", "a.csv")], None, size).select(F.col("id").cast("int"), F.coalesce("the text", F.lit("")), "row_index")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(rows)] + [(9, "not closed\nat the end", 61)]
    assert R.read_csv(spark, str(tmp_path / "c.csv")).count() == 0
    (tmp_path / "c.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        R.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])


def test_manifest_and_labels(spark, tmp_path):
    line = lambda i, year, title: (i, year, "Accept", "p", "h", "note", "d", title)
    df = spark.createDataFrame([line("a", 2020, 'one "x"\ntwo'), line("b", 2021, "u"), line("a", 2022, "later, and last"), line("c", 2020, "v")], IO.MANIFEST).coalesce(1)
    O.write_csv(df, str(tmp_path / "m"))
    held = {r["submission_id"]: (r["year"], r["title"]) for r in IO.load_manifest(spark, str(tmp_path / "m"), split_bytes=60).collect()}
    assert held == {"a": (2022, "later, and last"), "b": (2021, "u"), "c": (2020, "v")}
    assert sorted((r["submission_id"], r["title"]) for r in IO.load_manifest(spark, str(tmp_path / "m"), 2020).collect()) == [("a", 'one "x"\ntwo'), ("c", "v")]
    (tmp_path / "t.csv").write_text("year,id\n1,x\n2,y\n")
    (tmp_path / "u.csv").write_text("id,year\nz,3\n")
    got = IO.labelled_csvs(spark, {"train": str(tmp_path / "t.csv"), "test": str(tmp_path / "u.csv")}, ["id", "year"]).collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == [("x", "1", "train", 0), ("y", "2", "train", 1), ("z", "3", "test", 2)]


def test_small_splits_share_tasks_and_passes(spark, tmp_path):
    """Headers and counts come from the first pass, and a task reads many splits; so labelled CSVs take one more pass, of few tasks."""
    with open(tmp_path / "t.csv", "w") as f:
        f.write("\n" * 200 + '"i\nd",year\n' + "".join(f'"x\n{i}",{i}\n' for i in range(3000)))
    (tmp_path / "u.csv").write_text('"i\nd",year')
    paths = [str(tmp_path / "t.csv"), str(tmp_path / "u.csv")]
    assert R.file_lines(spark, paths, 64).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # hundreds before
    rows, n = R.counted_csv(spark, paths, None, 64)
    assert rows.columns == ["i\nd", "year", "row_index"] and n.first()["n"] == 3000
    assert sorted((r[2], r[0], r[1]) for r in rows.collect()) == [(i, f"x\n{i}", str(i)) for i in range(3000)]
