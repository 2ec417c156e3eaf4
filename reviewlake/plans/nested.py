"""Queries of nested data: reviews, layout items, markdown, prompts, generation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.functions import markdown as M
from reviewlake.functions import text as X
from reviewlake.operators import assembly as A
from reviewlake.operators import generation as G
from reviewlake.operators import layout as Y
from reviewlake.operators import notes as N
from reviewlake.plans.registry import query


def _reviews(load):
    """Line items in the role of an order's reviews, in order of line number."""
    rows = load("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: F.when(x["l_returnflag"] != "N", x["l_returnflag"])).alias("reviews"))


@query(
    "reviews_pivot_12",
    "SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN rn = {i} AND l_returnflag <> 'N' THEN l_returnflag END) AS review_{i}" for i in range(1, 13)) + " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS rn FROM lineitem) GROUP BY l_orderkey",
)
def reviews_pivot_12(load):
    """P5, C7."""
    return _reviews(load).select("l_orderkey", *N.reviews_columns(F.col("reviews")))


@query("all_or_null_reviews", "SELECT l_orderkey, CASE WHEN count_if(l_returnflag = 'N') = 0 THEN string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) END AS reviews FROM lineitem GROUP BY l_orderkey")
def all_or_null_reviews(load):
    """P7, A17, C8."""
    return _reviews(load).select("l_orderkey", F.array_join(N.all_or_null(F.col("reviews")), "").alias("reviews"))


@query("technical_indicators", "SELECT doc_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS binary, coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id END, 0) AS citations FROM documents LEFT JOIN labels USING (doc_id)")
def technical_indicators(load):
    """P8."""
    d = load("documents").join(load("labels"), "doc_id", "left")
    t = N.technical_indicators(F.when(F.col("quality") == 1, "Accept (Poster)").otherwise("Unknown"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), F.array(F.lit(1)))
    return d.select("doc_id", t["binary_decision"].alias("binary"), t["citations"].alias("citations"))


@query("image_count_valid", "SELECT l_orderkey, count(*) = max(l_linenumber) AS valid FROM lineitem GROUP BY 1")
def image_count_valid(load):
    """F3, S7."""
    return load("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.max("l_linenumber") - 1).alias("e")).select("l_orderkey", N.valid_images(F.col("n"), F.col("e")).alias("valid"))


def _notes(load):
    """Conversations in the role of notes with replies."""
    turn = F.col("turn")
    kind = F.when(turn % 4 == 0, "Official_Review").when(turn % 4 == 1, "Official_Comment").when(turn % 4 == 2, "Decision").otherwise("Meta_Review")
    text = F.when(turn % 8 == 2, "").when(F.col("conv_id") % 3 == 0, "Accept (Oral)").otherwise("Reject")
    content = F.create_map(F.lit("decision"), F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(text.alias("value")))).otherwise(text), F.lit("rating"), F.concat((turn + 1).cast("string"), F.lit(": fair")))
    reply = F.struct(turn.alias("pos"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(F.lit("ICLR/-/"), kind).alias("invitation"), F.array(F.lit("x")).alias("invitations"), content.alias("content"))
    return load("conversations").groupBy("conv_id").agg(F.collect_list(reply).alias("replies")).withColumn("replies", F.array_sort("replies", lambda a, b: (a["pos"] - b["pos"]).cast("int")))


@query(
    "reviews_extracted",
    """SELECT conv_id, count_if(turn % 4 = 0) AS n_reviews, min(CASE WHEN turn % 4 = 0 THEN turn + 1 END)::INTEGER AS first_score,
  CASE WHEN conv_id % 2 = 0 THEN arg_min(conv_id::VARCHAR || '/' || turn::VARCHAR, turn) FILTER (turn % 4 = 2) ELSE arg_min(conv_id::VARCHAR || '/' || turn::VARCHAR, turn) FILTER (turn % 4 = 3) END AS meta_id,
  CASE WHEN count_if(turn % 8 = 6) > 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'Accept (Oral)' ELSE 'Reject' END ELSE 'Accept (Poster)' END AS decision FROM conversations GROUP BY conv_id""",
)
def reviews_extracted(load):
    """P3, P18, P19, N3."""
    notes = _notes(load).withColumn("year", F.when(F.col("conv_id") % 2 == 0, 2022).otherwise(2024))
    reviews, meta = N.official_reviews(F.col("replies")), N.meta_review(F.col("replies"), F.col("year"))
    return notes.select("conv_id", F.size(reviews).cast("long").alias("n_reviews"), N.bounded_score(N.unwrap(F.get(reviews, 0)["content"], "rating"), 0, 10).alias("first_score"), meta["id"].alias("meta_id"), N.note_decision(F.col("replies"), F.lit("ICLR poster")).alias("decision"))


@query("prompt_rows", "SELECT conv_id, 'review' AS type, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS review_index, text AS original FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'meta_review', -1, arg_min(text, turn) FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def prompt_rows(load):
    """P16, W4, E8."""
    rows = load("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("u"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("m"), F.count_if(F.col("role") == "assistant").alias("k"))
    prompts = N.prompt_rows(F.transform("u", lambda x: x["text"]), F.when(F.col("k") > 0, F.col("m")))
    return rows.select("conv_id", F.explode(prompts).alias("p")).select("conv_id", "p.type", "p.review_index", "p.original")


@query("first_valid_json", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id END AS n FROM events")
def first_valid_json(load):
    """X1-X3."""
    good = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("event_id").alias("n")))
    wrapped = F.concat(F.lit('Result: {"properties": '), good, F.lit("} end"))
    made = F.array(F.lit("no json"), F.lit('{"name": "x"}'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), good)).when(F.col("event_id") % 3 == 1, wrapped).otherwise("{}"))
    got = N.first_valid_json(made, "name string, n bigint", ["name", "n"])
    return load("events").select("event_id", got["name"].alias("name"), got["n"].alias("n"))


@query("generated", "SELECT conv_id, turn, 2 AS n, length(text) AS length FROM conversations")
def generated(load):
    """Prompts through the stub backend, parsed by expressions."""
    made = G.generate(load("conversations").select("conv_id", "turn", F.col("text").alias("prompt")), G.StubBackend, n=2)
    return made.select("conv_id", "turn", F.size("completions").alias("n"), F.regexp_extract(F.get("completions", 0), r'"length": (\d+)', 1).cast("long").alias("length"))


def _items(load):
    """Documents in the role of layouts: a title, an abstract, text by lines, footers, thanks, references; how many of each varies."""
    blank = {"type": "string", "text": "string", "text_level": "int", "bbox": "array<double>", "page_idx": "int", "sub_type": "string", "img_path": "string", "image_caption": "array<string>", "table_body": "string", "table_caption": "array<string>", "list_items": "array<string>", "code_body": "string", "guess_lang": "string"}

    def item(**given):
        return F.struct(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in blank.items()])

    lines = F.transform(F.split("text", "\n"), lambda x, i: item(type=F.lit("text"), text=x, bbox=F.array(F.lit(100.0), F.lit(0.0), F.lit(900.0), F.lit(9.0)), page_idx=(i / 3 + 1).cast("int")))
    head = lambda t: item(type=F.lit("text"), text=F.lit(t), text_level=F.lit(1), bbox=F.array(F.lit(100.0), F.lit(0.0), F.lit(900.0), F.lit(9.0)), page_idx=F.lit(0))
    times = lambda x, n: F.array_repeat(x, (F.col("doc_id") % n).cast("int"))
    abstract = item(type=F.lit("text"), text=F.lit("The abstract."), bbox=F.array(F.lit(140.0), F.lit(0.0), F.lit(900.0), F.lit(9.0)), page_idx=F.lit(0))
    ref = item(type=F.lit("list"), sub_type=F.lit("ref_text"), list_items=F.array(F.lit("[1] A paper")), page_idx=(F.col("doc_id") % 10).cast("int"))
    foot = item(type=F.lit("footer"), text=F.lit("see github"), page_idx=F.lit(2))
    thanks = item(type=F.lit("text"), text=F.lit("Thanks."))
    parts = F.concat(F.array(head("Title")), times(abstract, 3), F.array(head("A b s t r a c t"), abstract, head("1 Introduction")), lines, times(foot, 4), F.array(head("Acknowledgments"), thanks), times(thanks, 5), F.array(head("References"), ref, head("Appendix")), times(thanks, 2))
    return load("documents").select("doc_id", "text", parts.alias("items"))


@query(
    "layout_filter",
    "SELECT doc_id, true AS has_abstract, (doc_id % 10)::INTEGER AS page_end, len(string_split(text, chr(10))) + 3 AS kept, 3 + doc_id % 3 AS before, 1 + doc_id % 2 AS after, 2 + doc_id % 5 AS ack, doc_id % 4 AS foot FROM documents",
)
def layout_filter(load):
    """C1-C5, F15."""
    got = Y.filter_layout(_items(load))
    count = lambda why: F.size(F.filter("layout_reason", lambda x: x == why)).cast("long")
    return got.select("doc_id", "has_abstract", "page_end", count("").alias("kept"), count("before_intro").alias("before"), count("after_references").alias("after"), count("acknowledgments").alias("ack"), count("footnote").alias("foot"))


@query("layout_markdown", "SELECT doc_id, md5(chr(10) || '# 1 INTRODUCTION' || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: chr(10) || x || chr(10)), chr(10)) || chr(10) || chr(10) || '# REFERENCES' || chr(10) || chr(10) || '- [1] A paper' || chr(10)) AS md FROM documents")
def layout_markdown(load):
    """C6, T24, E9."""
    got = Y.filter_layout(_items(load))
    return got.select("doc_id", F.md5(Y.render_markdown(Y.kept_items(F.col("items"), F.col("layout_reason")))).alias("md"))


@query("bbox_points", "SELECT vec_id, round(abs(embedding[1]::DOUBLE) * 612 / 1000, 6) AS x, round(abs(embedding[2]::DOUBLE) * 792 / 1000, 6) AS y FROM embeddings")
def bbox_points(load):
    """P14."""
    box = Y.to_points(F.transform(F.slice("embedding", 1, 4), lambda v: F.abs(v.cast("double"))), F.lit(612.0), F.lit(792.0))
    return load("embeddings").select("vec_id", F.round(F.get(box, 0), 6).alias("x"), F.round(F.get(box, 1), 6).alias("y"))


def _markdown():
    """Documents in the role of converted papers: their text without hash signs as the introduction, and some other sections or none."""
    some = lambda n, text: F.when(F.col("doc_id") % n > 0, text).otherwise("")
    body = F.regexp_replace(F.translate("text", "#*", ""), "[0-9]", "")
    return F.concat(
        F.lit("# Title\n\n"), some(7, "## **ABSTRACT**\n\nThe abstract.\n\n"), F.lit("# 1 <span id='a'></span>Introduction\n\n**054 055**"), body, some(3, "\n\n# Acknowledgements\n\nThanks."), some(4, "\n\n# Reproducibility Statement\n\nAll code."), F.lit("\n\n# 2 Results\n\n327\n\nDone."),
        some(5, "\n\n# References\n\n[1] One."), F.lit("\n\n# Appendix\n\nMore."),
    )


_BODY = "regexp_replace(translate(text, '#*', ''), '[0-9]', '', 'g')"


@query("md_flags", "SELECT doc_id, doc_id % 7 > 0 AS abstract, doc_id % 5 > 0 AS refs, doc_id % 3 > 0 AS ack, doc_id % 4 > 0 AS repro, 3 + (doc_id % 7 > 0)::INTEGER + (doc_id % 5 > 0)::INTEGER + (doc_id % 3 > 0)::INTEGER + (doc_id % 4 > 0)::INTEGER AS headers FROM documents")
def md_flags(load):
    """T2-T4, T19, F12."""
    d, md = load("documents"), _markdown()
    return d.select("doc_id", M.has_abstract_header(md).alias("abstract"), M.has_references(md).alias("refs"), M.has_acknowledgement(md).alias("ack"), M.has_reproducibility(md).alias("repro"), (F.size(M.header_lines(md)) - 1).alias("headers"))


@query("line_number_strip", r"SELECT doc_id, regexp_replace(replace(text, '**', ''), '\d', '', 'g') AS text FROM documents")
def line_number_strip(load):
    """T3."""
    body = F.concat(F.lit("**054 055**"), F.regexp_replace(F.replace(F.col("text"), F.lit("**"), F.lit("")), r"\d", ""))
    return load("documents").select("doc_id", M.strip_line_numbers(body).alias("text"))


@query(
    "md_sections",
    rf"""SELECT doc_id, 4 + (doc_id % 7 > 0)::INTEGER + (doc_id % 5 > 0)::INTEGER + (doc_id % 3 > 0)::INTEGER + (doc_id % 4 > 0)::INTEGER AS n, '1' AS number, regexp_replace('**054 055**' || {_BODY}, '^\s+|\s+$', '', 'g') AS content,
  CASE WHEN doc_id % 7 > 0 THEN 'The abstract.' END AS abstract, true AS intro FROM documents""",
)
def md_sections(load):
    """T6-T9."""
    rows = load("documents").select("doc_id", M.md_sections(_markdown()).alias("s"), M.md_abstract(_markdown()).alias("abstract"))
    one = F.get(F.filter("s", lambda x: x["title"] == "Introduction"), 0)
    short = F.when(F.col("doc_id") % 7 > 0, F.col("abstract"))  # without its header it is the title's text if long
    return rows.select("doc_id", F.size("s").alias("n"), one["number"].alias("number"), one["content"].alias("content"), short.alias("abstract"), M.has_intro(F.col("s")).alias("intro"))


@query(
    "md_clean",
    rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace({_BODY}, '[ \t\r\f\x0B]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 THEN '# 1 INTRODUCTION' || CASE WHEN trim(body, E' \n\t\r') = '' THEN '' ELSE chr(10) || chr(10) || trim(body, E' \n\t\r') END || chr(10) || chr(10) || '# 2 RESULTS' || chr(10) || chr(10) || 'Done.' || chr(10) || chr(10) || '# REFERENCES' || chr(10) || chr(10) || '[1] One.' END AS clean, 0 AS ack_in_preamble FROM d""",
)
def md_clean(load):
    """T16-T18, T10, T11."""
    d = load("documents").select("doc_id", M.md_clean(_markdown()).alias("clean"), M.md_preamble(_markdown()).alias("preamble"))
    return d.select("doc_id", "clean", F.size(F.regexp_extract_all("preamble", F.lit(r"(?im)^#+ *acknowledg"), 0)).alias("ack_in_preamble"))


@query(
    "url_sentences_removed",
    r"""SELECT doc_id, trim(regexp_replace(replace(text, 'http', 'hxxp') || CASE WHEN right(replace(text, 'http', 'hxxp'), 1) = '.' THEN '' ELSE '.' END || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' Kept' || doc_id || '.' ELSE 'com/x now.' END || ' Last one.', '\s+', ' ', 'g')) AS text FROM documents""",
)
def url_sentences_removed(load):
    """Links in whole sentences, and broken ones, whose sentence ends at the first full stop after them."""
    text = F.replace(F.col("text"), F.lit("http"), F.lit("hxxp"))
    kind = F.col("doc_id") % 3
    added = F.when(kind == 0, " See https://x.org/a?b now, and.").when(kind == 1, F.concat(F.lit(" Kept"), F.col("doc_id").cast("string"), F.lit("."))).otherwise(" Code at HTTPS:// github.com/x now.")
    return load("documents").select("doc_id", M.without_url_sentences(F.concat(text, F.when(F.endswith(text, F.lit(".")), "").otherwise("."), added, F.lit(" Last one."))).alias("text"))


@query("strip_footnotes", "SELECT doc_id, translate(text, '<†‡', '') || chr(10) || chr(10) || '<sup>2</sup> See Figure ' || doc_id::VARCHAR || chr(10) || '<sup>(</sup>a) kept' AS text FROM documents")
def strip_footnotes(load):
    """T3."""
    body = F.concat(F.translate("text", "<†‡", ""), F.lit("\n<sup>1</sup> https://x\n<sup>2</sup> See Figure "), F.col("doc_id").cast("string"), F.lit("\n<sup>(</sup>a) kept"))
    return load("documents").select("doc_id", M.strip_footnotes(body).alias("text"))


@query(
    "legacy_rows",
    "SELECT conv_id, CASE WHEN t IS NULL OR t % 8 = 2 THEN '' WHEN conv_id % 3 = 0 THEN 'Accept (Oral)' ELSE 'Reject' END AS paper_decision, n AS reviews, '{}' AS author_main_response FROM (SELECT conv_id, min(turn) FILTER (turn % 4 = 2) AS t, CAST(count_if(turn % 4 = 0) AS INTEGER) AS n FROM conversations GROUP BY conv_id)",
)
def legacy_rows(load):
    """P11."""
    notes = _notes(load).select(F.col("conv_id").alias("id"), F.lit(2020).alias("year"), F.lit(0).cast("long").alias("cdate"), F.lit(0).cast("long").alias("mdate"), F.create_map(F.lit("title"), F.lit("t")).alias("content"), "replies")
    return A.legacy_row(notes, "c", 1).select(F.col("submission_id").alias("conv_id"), "paper_decision", F.json_array_length("reviewer_response_json").alias("reviews"), "author_main_response")


@query(
    "assembled_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS submission_id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'https://site/pdf/' || o_orderkey ELSE '' END AS pdf_download_link, CASE WHEN o_orderkey % 5 = 0 THEN '/layout/' || o_orderkey ELSE '' END AS layout_path, n.normalized_reviews FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN count_if(l_returnflag = 'N') = 0 THEN '[' || string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_returnflag) || ']' END AS normalized_reviews FROM lineitem GROUP BY l_orderkey) n ON o_orderkey = l_orderkey",
)
def assembled_rows(load):
    """J10."""
    orders, reviews = load("orders"), _reviews(load).withColumnRenamed("l_orderkey", "o_orderkey")
    key = F.col("o_orderkey").cast("string").alias("submission_id")
    notes = orders.join(reviews, "o_orderkey", "left").select(key, F.year("o_orderdate").alias("year"), F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.lit("Reject").alias("decision"), F.array(F.lit(1)).alias("ratings"), "reviews", F.lit(None).cast("struct<text: string>").alias("meta"))
    each = reviews.select(key, F.posexplode("reviews").alias("review_index", "normalized")).withColumns({"type": F.lit("review"), "pos": F.lit(0)})
    none = lambda name, kind="string": orders.limit(0).select(key, F.lit(None).cast(kind).alias(name))
    path = lambda top, name: F.concat(F.lit(top), F.col("o_orderkey").cast("string")).alias(name)
    manifest = orders.filter("o_orderkey % 3 = 0").select(key, path("/pdf/", "pdf_path"))
    layouts = orders.filter("o_orderkey % 5 = 0").select(key, path("/layout/", "path"), path("/md/", "md_path"))
    rows = A.assemble(notes, A.normalized_reviews(each), manifest, layouts, none("path"), none("meta_json"), none("images", "map<string, string>"), none("paths", "array<string>"), none("content_list"), none("gs_citation", "int"), "https://site", "/root")
    return rows.select("submission_id", "year", "pdf_download_link", F.col("_mineru_path").alias("layout_path"), "normalized_reviews")
