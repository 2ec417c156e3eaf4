"""Assembled rows, legacy rows, holdouts and files of submissions on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import assembly as A

NOTE = "id string, year int, cdate long, mdate long, content map<string,string>, replies array<struct<id:string,invitation:string,invitations:array<string>,content:map<string,string>>>"


def test_legacy_row(spark):
    old = [("r1", "c/Official_Review", None, {"rating": "5"}), ("r2", "c/Official_Review/x", None, {"rating": "6"}), ("d", "c/Decision", None, {"decision": "Accept", "metareview": "fine"}), ("a", "c/Author_Comment", None, {"t": "thanks"})]
    new = [("r1", None, ["v", "c/Official_Review1"], {"rating": '{"value": "5"}'}), ("d", None, ["c/Decision"], {"decision": '{"value": "Reject"}'}), ("m", None, ["c/Meta_Review"], {"metareview": '{"value": "poor"}'}), ("a", None, ["c/Author"], {"t": "no"})]
    rows = spark.createDataFrame([("a", 2020, 1500, 0, {"title": "T"}, old), ("b", 2024, 1000, None, {"title": '{"value": "U"}', "primary_area": '{"value": "x"}'}, new), ("c", 2024, None, None, {}, None)], NOTE)
    one, two, none = (A.legacy_row(rows.filter(F.col("id") == i), "C", v).first() for i, v in (("a", 1), ("b", 2), ("c", 2)))
    assert len(one) == 16 and (one["title"], one["paper_decision"], one["meta_review"], one["last_modified_date"]) == ("T", "Accept", "fine", "")
    assert one["publish_date"].endswith("01.500000") and two["publish_date"].endswith(":01") and one["keywords"] == "[]"
    assert json.loads(one["reviewer_response_json"]) == [{"id": "r1", "content": {"rating": "5"}}] == json.loads(two["reviewer_response_json"])
    assert json.loads(one["author_main_response"]) == {"t": "thanks"} and two["author_main_response"] == "{}"
    assert (two["title"], two["primary_area"], two["paper_decision"], two["meta_review"]) == ("U", "x", "Reject", "poor")
    assert (none["title"], none["reviewer_response_json"], none["paper_decision"], none["revisions_json"]) == ("", "[]", "", "[]")


def test_files_of_submissions(spark, tmp_path):
    files = spark.createDataFrame([(p,) for p in ("/r/2020/a/images/page_2.PNG", "/r/2020/a/images/page_10.png", "/r/2020/a/images/x.txt", "/r/2020/a/a.md", "/r/2021/b/c.md", "/p/2020/a_old.pdf", "/p/2021/a_old.pdf")], "path string")
    got = A.image_paths(files, "images").collect()
    assert [(r["submission_id"], r["paths"]) for r in got] == [("a", ["/r/2020/a/images/page_10.png", "/r/2020/a/images/page_2.PNG"])] and set(got[0]["images"]) == {"page_10.png", "page_2.PNG"}
    ids = spark.createDataFrame([(2020, "a"), (2021, "b")], "year int, id string")
    assert {r["id"]: r["md_path"] for r in A.with_markdown_path(ids, files).collect()} == {"a": "/r/2020/a/a.md", "b": None}
    folders = spark.createDataFrame([(2022, "a", "/f/2022/a"), (2021, "a", "/f/2021/a")], "year int, id string, path string")
    assert {r["id"]: (r["folder_year"], r["folder"]) for r in A.submission_folders(ids, folders).collect()} == {"a": (2021, "/f/2021/a"), "b": (None, None)}
    with pytest.raises(Exception, match="no folder of submission b"):
        A.submission_folders(ids, folders, strict=True).collect()
    changed = spark.createDataFrame([("a", "old"), ("b", ""), ("c", None), ("d", "gone")], "submission_id string, old_download_id string")
    assert [tuple(r) for r in A.pdf_backups(changed, files, 2020, "2020_old_download_id").collect()] == [("/p/2020/a_old.pdf", "/p/2020_old_download_id/a_old.pdf")]
    held = tmp_path / "task1.json"
    held.write_text(json.dumps({"2020": [{"id": "a", "title": "x"}], "2021": []}, indent=1))
    found = A.load_holdout(spark, str(held), "id string, title string")
    assert [(r["year"], r["example"]["title"]) for r in found.collect()] == [("2020", "x")]
    assert [r["id"] for r in A.without_holdout(ids, found).collect()] == ["b"]
    assert A.without_holdout(ids, A.load_holdout(spark, str(tmp_path / "none.json"))).count() == 2


def test_assemble(spark):
    notes = spark.createDataFrame([("a", 2020, "T", "Abs.", "Accept (Oral)", [1], [("5",), ("6",)], ("m",)), ("b", 2026, "U", None, "Reject", [], [("1",)], ("m",)), ("c", 2021, "V", "", "Reject", None, None, None)], "submission_id string, year int, title string, abstract string, decision string, ratings array<int>, reviews array<struct<rating:string>>, meta struct<text:string>")
    norm = A.normalized_reviews(spark.createDataFrame([("a", "review", 0, '{"old": 1}', 0), ("a", "review", 0, '{"x": 1}', 1), ("a", "review", 1, '{"x": 2}', 2), ("a", "meta", -1, '{"m": 1}', 3), ("b", "review", 0, None, 4)], "submission_id string, type string, review_index int, normalized string, pos int"))
    side = lambda schema, *rows: spark.createDataFrame(list(rows), "submission_id string, " + schema)
    got = A.assemble(notes, norm, side("pdf_path string", ("a", "/pdf/a")), side("path string, md_path string", ("a", "/l", "/l.md")), side("path string", ("b", "/m")), side("meta_json string", ("a", '{"original_pdf_path": "/o.pdf"}')), side("images map<string,string>", ("a", {"p": "/p"})), side("paths array<string>"), side("content_list string"), side("gs_citation int", ("a", 3)), "https://x", "/root")
    assert len(got.columns) == 22
    rows = {r["submission_id"]: r for r in got.collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert json.loads(a["normalized_reviews"]) == [{"x": 1}, {"x": 2}] and a["normalized_metareview"] == '{"m": 1}' and b["normalized_reviews"] is None and c["normalized_reviews"] is None
    assert (a["pdf_download_link"], b["pdf_download_link"], a["_pdf_path"], b["clean_md_path"], a["_normalized_path"]) == ("https://x/pdf/a", "", "/o.pdf", "/m", "/root/2020/a")
    assert json.loads(a["original_metareview"]) == {"text": "m"} and b["original_metareview"] is None and json.loads(a["technical_indicators"])["citations"] == 3
    assert (a["images_in_clean_md"], b["images_in_clean_md"], a["clean_pdf_img_paths"], c["original_reviews"]) == ('{"p":"/p"}', "{}", "[]", "[]")
