"""Joins, splits, layouts, notes, sources and sinks on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import generation, layout, lookups, notes, prefixes, splits, statistics
from reviewlake.sources import files


def test_two_key_lookup(spark):
    papers = spark.createDataFrame([("a", "x", 5, 1), ("b", "y", -1, 2), (None, "y", 7, 3), ("d", "z", 1, 4), ("d", "z", 2, 5)], "id string, normalized_title string, gs_citation int, pos int")
    rows = spark.createDataFrame([("a", "?"), ("b", "Y!"), ("c", "y"), ("d", "z"), ("e", None)], "id string, title string")
    got = {r["id"]: r["gs_citation"] for r in lookups.two_key_lookup(rows.withColumnRenamed("id", "pid"), papers, "pid", "title").withColumnRenamed("pid", "id").collect()}
    assert got == {"a": 5, "b": None, "c": 7, "d": 2, "e": None}


def test_prefix_and_priority(spark):
    ids = spark.createDataFrame([(2020, "ab"), (2020, "abc"), (2021, "ab"), (2020, "zz"), (2020, "longid")], "year int, id string")
    index = spark.createDataFrame([(2020, "abc_2", 1, "p1"), (2020, "ab_1", 2, "p2"), (2020, "abc_1", 3, "p3"), (2020, "longid_7", 0, "p4")], "year int, stem string, priority int, path string")
    got = {(r["year"], r["id"]): r["stem"] for r in prefixes.prefix_lookup(ids, index).collect()}
    assert got == {(2020, "ab"): "ab_1", (2020, "abc"): "abc_1", (2021, "ab"): None, (2020, "zz"): None, (2020, "longid"): "longid_7"}
    best = {r["id"]: r["path"] for r in prefixes.priority_lookup(ids.filter("year = 2020"), index).collect()}
    assert best == {"ab": "p1", "abc": "p1", "zz": None, "longid": "p4"}


def test_latest_before_ties_to_last(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 5, 2, "y"), ("a", 5, 3, "z"), ("a", 9, 4, "late"), ("b", None, 5, "n")], "id string, ts int, pos int, pdf string")
    assert {r[0]: r[1] for r in lookups.latest_before(rows, "id", "ts", "pos", F.col("pdf"), F.lit(9)).collect()} == {"a": "z"}


def test_reply_counts_use_substrings(spark):
    reviews = spark.createDataFrame([("f", "r1", "AnonReviewer1")], "forum string, id string, reviewer string")
    comments = spark.createDataFrame([("a1", "f", "r1", "x/Authors"), ("c1", "f", "a1", "x/AnonReviewer10"), ("c2", "f", "a1", "x/AnonReviewer2")], "id string, forum string, replyto string, signatures string")
    assert [tuple(r) for r in lookups.reply_counts(reviews, comments).collect()] == [("f", "r1", 1, 1)]


@pytest.mark.parametrize("total,tasks", [(7, 3), (6, 3), (2, 5), (100, 7)])
def test_splits(spark, total, tasks):
    i = F.col("id")
    rows = spark.range(total).select(splits.split_first_larger(i, total, tasks).alias("f"), splits.split_last_larger(i, total, tasks).alias("l")).collect()
    size, more = divmod(total, tasks)
    assert [r["f"] for r in rows] == [t for t in range(tasks) for _ in range(size + (t < more))]
    assert [r["l"] for r in rows] == ([tasks - 1] * total if size == 0 else [min(i // size, tasks - 1) for i in range(total)])


def test_row_index(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert [r["row_index"] for r in splits.row_index(rows, "k").orderBy("k").collect()] == list(range(1000))


def test_contamination_target_is_a_double_floor(spark):
    rows = spark.range(200).select(F.when(F.col("id") < 100, 2024).otherwise(2020).alias("year"), "id", F.lit(None).cast("string").alias("pin"))
    got = splits.contamination_split(rows, "year", "id", "pin").groupBy("year", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(2024, "test"): 19, (2024, "train"): 81, (2020, "train"): 80, (2020, "test"): 20}


def test_balanced_sample_needs_enough(spark):
    rows = spark.createDataFrame([(1, i, "accept" if i < 3 else "reject", i % 2 == 0) for i in range(5)], "y int, id int, label string, complete boolean")
    with pytest.raises(Exception, match="fewer negatives"):
        splits.balanced_sample(rows, "y", "id", "label", "complete").collect()


def test_funnel_counts_are_cumulative(spark):
    rows = spark.createDataFrame([(1, True, False), (1, True, None), (1, False, True), (2, True, True)], "y int, a boolean, b boolean")
    got = {r["y"]: (r["total"], r["a"], r["b"]) for r in statistics.funnel(rows, "y", {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {1: (3, 2, 0), 2: (1, 1, 1), None: (4, 3, 1)}


def item(**kw):
    names = ["type", "text", "text_level", "bbox", "page_idx", "sub_type", "img_path", "image_caption", "table_body", "table_caption", "list_items", "code_body", "guess_lang"]
    return tuple(kw.get(n) for n in names)


def layout_rows(spark, items):
    return spark.createDataFrame([(items,)], f"items array<{layout.ITEM}>")


def test_layout_filter(spark):
    box = [100.0, 0.0, 900.0, 9.0]
    items = [
        item(type="text", text="Title", text_level=1), item(type="text", text="Abstract", text_level=1), item(type="text", text="a", bbox=[140.0, 0.0, 1.0, 1.0]), item(type="text", text="b", bbox=[109.0, 0.0, 1.0, 1.0], page_idx=0),
        item(type="header", text="run", page_idx=1), item(type="page_footnote", text="see GitHub", page_idx=3), item(type="page_footnote", text="fine", page_idx=3), item(type="text", text="Reproducibility", text_level=1), item(type="text", text="r"),
        item(type="text", text="2 More", text_level=1, bbox=box), item(type="text", text="References", text_level=1), item(type="list", sub_type="ref_text", page_idx=8), item(type="text", text="Appendix", text_level=1, page_idx=9),
    ]
    got = layout.filter_layout(layout_rows(spark, items)).first()
    assert got["layout_reason"] == ["before_intro"] * 3 + ["", "header", "footnote", "", "reproducibility", "reproducibility", "", "", "", "after_references"]
    assert got["has_abstract"] and got["page_end"] == 8 and got["references_idx"] == 10
    none = layout.filter_layout(layout_rows(spark, [item(type="text", text="x", page_idx=4)])).first()
    assert none["layout_reason"] == ["no_abstract"] and none["page_end"] == 4 and not none["has_abstract"]
    assert layout.filter_layout(layout_rows(spark, [])).first()["layout_reason"] == []


def test_render_markdown(spark):
    items = [item(type="text", text="H", text_level=2), item(type="text", text="p"), item(type="image", img_path="a.png", image_caption=["c", "d"]), item(type="image"), item(type="table", table_body="<t>", table_caption=["cap"]), item(type="equation", text="x=1"), item(type="list", list_items=["i", "j"]), item(type="code", code_body="f()", guess_lang="py"), item(type="odd", text="?")]
    got = layout_rows(spark, items).select(layout.render_markdown(F.col("items"))).first()[0]
    assert got == "\n## H\n\n\np\n\n\n![c d](a.png)\n\n\ncap\n\n\n<t>\n\n\n$$\nx=1\n$$\n\n- i\n\n- j\n\n\n```py\nf()\n```\n"


def test_notes(spark):
    content = spark.createDataFrame([({"TLDR": "", "TL;DR": '{"value": "new"}', "x": "plain"},)], "c map<string, string>")
    got = content.select(notes.first_filled(F.col("c"), *notes.TLDR_KEYS).alias("t"), notes.unwrap(F.col("c"), "x").alias("x"), notes.unwrap(F.col("c"), "y").alias("y")).first()
    assert (got["t"], got["x"], got["y"]) == ("new", "plain", None)
    arrays = spark.createDataFrame([(["a", None],), ([],), (["a"],)], "r array<string>")
    assert [r[0] for r in arrays.select(notes.all_or_null(F.col("r"))).collect()] == [None, None, ["a"]]
    made = spark.createDataFrame([(['{"a": 1}', 'text {"a": 1, "b": "x"} more', "none"],), (['{"properties": {"a": 2, "b": "y"}}'],), (["{}", None],)], "c array<string>")
    got = [r[0] for r in made.select(notes.first_valid_json(F.col("c"), "a int, b string", ["a", "b"])).collect()]
    assert [g and (g["a"], g["b"]) for g in got] == [(1, "x"), (2, "y"), None]


def test_generation(spark):
    rows = spark.createDataFrame([(1, "hello there"), (2, None)], "id int, prompt string")
    got = {r["id"]: r["completions"] for r in generation.generate(rows, generation.StubBackend, n=3).collect()}
    assert len(got[1]) == 3 and '"summary": "hello"' in got[1][0] and got[2] is None


def test_files(spark, tmp_path):
    for path, size in {"2020/ab.pdf": 20, "batch_1/ab_1/list.json": 11, "batch_2/ab_1/list.json": 12, "batch_2/c_1/list.json": 10, "2021/x/x.md": 5, "2021/y/z.md": 5, "img/ab/page_0.png": 3, "img/ab/page_1.png": 3}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    listed = files.list_files(spark, str(tmp_path), "*")
    assert [(r["year"], r["stem"]) for r in files.pdf_index(listed).collect()] == [(2020, "ab")]
    assert [(r["year"], r["stem"]) for r in files.markdown_index(listed).collect()] == [(2021, "x")]
    assert [(r["stem"], r["batch"]) for r in files.layout_index(listed).collect()] == [("ab_1", "batch_2")]
    assert [tuple(r) for r in files.image_counts(listed).collect()] == [("ab", 2)]


def test_sinks(spark, tmp_path):
    rows = spark.range(2500).select("id", (F.col("id") % 2).alias("split"))
    files.write_chunks(rows.coalesce(1), str(tmp_path / "chunks"))
    assert len(list((tmp_path / "chunks").glob("part-*"))) == 3
    files.write_by(rows, str(tmp_path / "by"), "split")
    files.write_by(rows.filter("split = 1").limit(1), str(tmp_path / "by"), "split")
    assert spark.read.parquet(str(tmp_path / "by")).groupBy("split").count().orderBy("split").collect()[1][1] == 1
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"id,title\n{name}1,t\n{name}2,u\n")
    got = files.labelled_csvs(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "b.csv")}, ["id"]).orderBy("row_index").collect()
    assert [(r["id"], r["label"], r["row_index"]) for r in got] == [("a1", "train", 0), ("a2", "train", 1), ("b1", "test", 2), ("b2", "test", 3)]


def test_registry_has_oracles():
    from reviewlake import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 60
