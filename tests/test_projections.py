"""Submissions, reviews by year, prompts, output indices, sinks and the command line on small hand-made rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from reviewlake import __main__ as cli
from reviewlake.functions import markdown as M
from reviewlake.operators import layout, prompts, reviews, splits, submissions
from reviewlake.sources import outputs

REPLY = "struct<id: string, replyto: string, signatures: array<string>, invitation: string, invitations: array<string>, content: map<string, string>>"


def parsed(spark, *asked, pretty=False):
    """Reviews (content, year) as JSON texts, in one job."""
    rows = spark.createDataFrame([(i, c, y) for i, (c, y) in enumerate(asked)], "i int, c map<string, string>, y int")
    return [r["x"] for r in rows.select("i", reviews.parse_review(F.col("c"), F.col("y"), pretty=pretty).alias("x")).orderBy("i").collect()]


def test_review_forms(spark):
    scores = {"rating": "5: fair", "confidence": '{"value": 3}', "soundness": "3 good", "presentation": "2", "contribution": "4", "summary": "s", "strengths": "", "weaknesses": "w", "questions": "q"}
    old = {"rating": "6: x", "review": "r", "experience_assessment": "e", "review_assessment:_checking_correctness_of_derivations_and_theory": "d", "review_assessment_experiments": "by name", "review_assessment:_thoroughness_in_paper_reading": "t"}
    good, listed, named, *bad = parsed(
        spark, (scores, 2024), (scores | {"flag_for_ethics_review": '["a"]'}, 2024), (old, 2020), (scores | {"rating": "11"}, 2025), (scores | {"confidence": "none"}, 2026), ({k: v for k, v in scores.items() if k != "questions"}, 2024), (scores, 2019), (None, 2024), (scores | {"flag_for_ethics_review": "a"}, 2024), (old, 2021)
    )
    got = json.loads(good)
    assert list(got) == ["rating", "confidence", "summary", "strengths", "weaknesses", "questions", "soundness", "presentation", "contribution", "flag_for_ethics_review", "details_of_ethics_concerns", "code_of_conduct", "number_of_author_responses", "number_of_reviewer_responses_to_author"]
    assert (got["rating"], got["confidence"], got["flag_for_ethics_review"], got["code_of_conduct"], got["details_of_ethics_concerns"]) == (5, 3, [], "Yes", None)
    assert json.loads(listed)["flag_for_ethics_review"] == ["a"] and json.loads(named)["review_assessment_experiments"] == "by name" and bad == [None] * 7


def test_threads_and_errors(spark):
    reply = lambda i, to, who, kind, content=None: (i, to, [who], kind, None, content)
    good = {"rating": "6", "confidence": "3", "review": "r"}
    replies = [
        reply("r1", "n", "x/AnonReviewer1", "Official_Review", good),
        reply("a1", "r1", "x/Authors", "Official_Comment"),
        reply("a2", "r1", "x/Authors", "Official_Comment"),
        reply("c1", "a1", "x/AnonReviewer1", "Official_Comment"),
        reply("c2", "r1", "x/AnonReviewer1", "Official_Comment"),
        reply("r2", "n", "x/AnonReviewer2", "Official_Review", {"rating": "6"}),
        ("r3", "n", None, None, ["v", "Official_Review"], good),
        reply("d", "n", "x/PCs", "Decision", {"comment": "no decision"}),
    ]
    rows = spark.createDataFrame([(replies,), (None,)], f"replies array<{REPLY}>").select(reviews.note_reviews(F.col("replies"), F.lit(2021)).alias("r"), reviews.note_meta(F.col("replies"), F.lit(2021)).alias("m")).collect()
    counts = [(x["number_of_author_responses"], x["number_of_reviewer_responses_to_author"]) for x in map(json.loads, rows[0]["r"])]
    assert counts == [(2, 1), (0, 0)] and tuple(rows[0]["m"]) == (None, True) and rows[1]["r"] == [] and tuple(rows[1]["m"]) == (None, False)


def test_pretty_json_and_form_texts(spark):
    content = {"rating": "5", "confidence": "3", "soundness": "3", "presentation": "2", "contribution": "4", "summary": 'a "b"\n', "strengths": "é", "weaknesses": "/", "questions": "q", "flag_for_ethics_review": '["x", "y"]'}
    (text,), (plain,) = parsed(spark, (content, 2024), pretty=True), parsed(spark, (content, 2024))
    assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) and json.loads(text) == json.loads(plain)
    assert reviews.form_text(reviews.UNIVERSAL_REVIEW).split("\n")[3:9] == [
        "- questions: list of str (optional) - Questions for authors",
        "- sources: list of Source (optional) - Papers/sources mentioned in the review",
        "  Fields for Source:",
        "    - ref: str (required) - Link or title of referenced paper",
        "    - within: str (required) - Which field: 'summary', 'strengths', 'weaknesses', 'questions'",
        "- technical_novelty_contribution: str or null (optional) - Technical novelty assessment (if mentioned)",
    ]
    assert json.loads(reviews.form_example(reviews.UNIVERSAL_REVIEW))["sources"] == [{"ref": "...", "within": "..."}]


def test_submission_rows(spark):
    note = ("n1", "n1", None, 2020, 0, 86_400_000, {"TLDR": "", "TL;DR": '{"value": "short"}', "venue": "ICLR 2020 poster", "pdf": "/pdf/x.pdf", "authors": '["A"]', "keywords": "broken"}, None)
    rows = spark.createDataFrame([note], f"id string, forum string, number int, year int, cdate long, mdate long, content map<string, string>, replies array<{REPLY}>")
    pdfs = spark.createDataFrame([(2020, "n1_b", "/p/n1_b.pdf"), (2020, "n1_a", "/p/n1_a.pdf"), (2021, "n1_0", "/p/0")], "year int, stem string, path string")
    got = submissions.submission(rows, "https://s", pdfs=pdfs).first()
    assert (got["number"], got["title"], got["tldr"], got["keywords"], got["authors"], got["pdf_url"], got["pdf_path"], got["decision"], got["creation_date"]) == (0, "", "short", [], ["A"], "https://s/pdf/x.pdf", "/p/n1_a.pdf", "Accept (Poster)", None)
    assert got["modification_date"] is not None and submissions.submission(rows.limit(0)).count() == 0
    plain = submissions.plain_submission(rows, F.lit("Reject")).first()
    assert (plain["authors"], plain["keywords"], plain["venue"], plain["tldr"]) == (["A"], None, None, None)


def test_prediction_options(spark):
    for bad in (dict(papers=True, fewshot=True), dict(pct=0.0), dict(pct=1.5), dict(column="x")):
        with pytest.raises(ValueError):
            submissions.check_options(**bad)
    submissions.check_options(pct=1.0)
    with pytest.raises(ValueError):
        prompts.prediction_prompt(4)
    row = spark.createDataFrame([(2026, "T", "A", [])], "year int, title string, abstract string, decisions array<string>")
    got = row.select(prompts.prediction_prompt(1, decisions=F.col("decisions")).alias("a"), prompts.prediction_prompt(2).alias("b"), prompts.prediction_prompt(7).alias("c")).first()
    assert got["a"] == "No decisions available for this year" and got["b"] == "No valid horizons" and got["c"].endswith('Answer: [Either "Accept" or "Reject"]')


def test_ranks_match_a_window(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), (F.col("id") % 5 == 0).alias("first"))
    order = splits.hash_order("id")
    got = {r["id"]: r["rank"] for r in splits.ranked(rows, ["g"], order, "id", "rank", F.when(F.col("first"), 0).otherwise(1)).collect()}
    from pyspark.sql import Window

    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("first"), order, "id")))
    assert got == {r["id"]: r["rank"] for r in want.collect()}
    labelled = rows.select("id", F.lit(1).alias("g"), F.when(F.col("id") < 2000, "accept").otherwise("reject").alias("label"), "first")
    with pytest.raises(Exception, match="fewer negatives"):
        splits.balanced_sample(labelled, "g", "id", "label", "first").collect()
    with pytest.raises(Exception, match="fewer negatives"):
        splits.balanced_sample(labelled.filter("label = 'accept'"), "g", "id", "label", "first").collect()


def test_outputs(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("submission_id"), F.lit("review").alias("type"), F.col("id").cast("int").alias("review_index"), F.lit('a "quoted", text').alias("prompt"))
    outputs.write_prompts(rows, f"{tmp_path}/prompts")
    parts = [outputs.load_prompts(spark, f"{tmp_path}/prompts", i, 3).count() for i in range(3)]
    assert sum(parts) == 10 and outputs.load_prompts(spark, f"{tmp_path}/prompts").count() == 10
    outputs.write_parts(rows, f"{tmp_path}/parts", 3)
    outputs.merge_shards(spark, [f"{tmp_path}/parts", f"{tmp_path}/prompts"], f"{tmp_path}/whole")
    assert len(list((tmp_path / "parts").glob("*.parquet"))) == 3 and len(list((tmp_path / "whole").glob("*.parquet"))) == 1 and spark.read.parquet(f"{tmp_path}/whole").count() == 20
    outputs.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first()["prompt"] == 'a "quoted", text'
    spark.createDataFrame([("a", "iclr", "t", 3), ("b", "other", "u", 4)], "id string, conference string, normalized_title string, gs_citation int").write.parquet(f"{tmp_path}/papers")
    cited = outputs.load_citations(spark, f"{tmp_path}/papers")
    assert [r["id"] for r in cited.collect()] == ["a"] and "EqualTo(conference,iclr)" in cited._jdf.queryExecution().toString()
    assert outputs.output_path("o", 7, "A\\B//c d", "v2", papers=True, dry_run=True) == "o/a-b-c-d/dry_run/task7_v2_paper"
    card = outputs.card_table(outputs.card_rows(spark.createDataFrame([(2020, 2000, 1, 2, 3, 4)], "year int, reviewable long, reject long, poster long, spotlight long, oral long"), spark.createDataFrame([(2020, 1500)], "year int, n long")))
    assert card.split("\n")[2:] == ["| 2020 | 2,000 | 1,500 | 75.0% | 1 | 2 | 3 | 4 |", "| **Total** | **2,000** | **1,500** | **75.0%** | **1** | **2** | **3** | **4** |"]


def test_layout_errors(spark):
    item = "type string, text string, text_level int, bbox array<double>, page_idx int, sub_type string, img_path string, image_caption array<string>, table_body string, table_caption array<string>, list_items array<string>, code_body string, guess_lang string"
    rows = spark.createDataFrame([(1, None), (2, []), (3, [("footer", "x", None, None, 0, None, None, None, None, None, None, None, None)])], f"id int, items array<struct<{', '.join(f.replace(' ', ': ', 1) for f in item.split(', '))}>>")
    got = {r["id"]: (r["success"], r["error"]) for r in layout.normalised_papers(rows).collect()}
    assert got[1] == got[2] == (False, "Empty content list") and got[3][0] == (got[3][1] is None)


def test_sentences_with_links():
    url = re.compile(M.URL, re.I)
    assert M.drop_sentences_with("", url) == "" and M.drop_sentences_with("no link", url) == "no link"
    assert M.drop_sentences_with("https://x.org/a", url) == "" and M.drop_sentences_with("A. B http://x.y z. C. D http://q.r/s, t", url) == "A. C."
    assert M.drop_sentences_with("See http://a.b and http://c.d now.\nNext  one.", url, False) == "d now.\nNext  one."


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "funnel_by_year" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", "x", "--out", "y"]) == 2 and cli.main(["run", "first_labels"]) == 2
    spark.createDataFrame([(1, "en", "s"), (2, "de", "s")], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert cli.main(["run", "first_labels", "--data", str(tmp_path), "--out", f"{tmp_path}/out", "--format", "csv"]) == 0
    assert spark.read.csv(f"{tmp_path}/out", header=True).first()["label"] == "en" and cli.main(["show", "first_labels", "--data", str(tmp_path), "--limit", "1"]) == 0
