"""Submissions as rows (P1, P2, S3), dataset rows (P6, P9, P10, P15), and the predicates that choose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import decisions as D
from reviewlake.functions import markdown as M
from reviewlake.operators.prefixes import prefix_lookup
from reviewlake.operators.notes import AREA_KEYS, TLDR_KEYS, first_filled, note_decision, reviews_columns, unwrap, valid_images
from reviewlake.operators.reviews import note_meta, note_reviews

# Fixed value: the canonical columns of the published dataset.
CANONICAL = T.StructType(
    [T.StructField("submission_id", T.StringType()), T.StructField("year", T.LongType())]
    + [
        T.StructField(n, T.StringType())
        for n in (
            "openreview_link", "pdf_download_link", "title", "original_abstract", "no_github_abstract", "original_md_path", "clean_md_path", "images_in_clean_md", "clean_pdf_img_paths", "original_reviews", "normalized_reviews",
            "original_metareview", "normalized_metareview", "technical_indicators", "metadata_of_changes", "submission_json", "content_list_json", "_pdf_path", "_mineru_path", "_normalized_path",
        )
    ]
)


def _texts(content: Column, key: str) -> Column:
    """A list of texts, [] if it is missing or empty."""
    return F.coalesce(F.from_json(unwrap(content, key), "array<string>"), F.array().cast("array<string>"))


def submission(notes: DataFrame, site: str = "", conference: str = "ICLR", pdfs: DataFrame | None = None) -> DataFrame:
    """A row a note(id, forum, number, year, cdate, mdate, content, replies); pdfs(year, stem, path) gives the local path, of
    several whose names begin with the id the first in order of names. Missing texts are empty, missing times null."""
    content = F.col("content")
    text = lambda *keys: F.coalesce(first_filled(content, *keys), F.lit(""))
    venue, pdf = text("venue"), text("pdf")
    local = F.lit("")
    if pdfs is not None:
        best = prefix_lookup(notes.select("id", "year").distinct(), pdfs).select(F.col("id").alias("_id"), F.col("year").alias("_year"), F.col("stem").alias("_stem"))
        paths = pdfs.groupBy(F.col("year").alias("_py"), F.col("stem").alias("_ps")).agg(F.min("path").alias("_path"))
        found = best.join(paths, (F.col("_year") == F.col("_py")) & (F.col("_stem") == F.col("_ps"))).drop("_py", "_ps", "_stem")
        notes = notes.join(found, (F.col("id") == F.col("_id")) & (F.col("year") == F.col("_year")), "left").drop("_id", "_year")
        local = F.coalesce("_path", F.lit(""))
    return notes.select(
        "id",
        "forum",
        F.coalesce("number", F.lit(0)).alias("number"),
        F.lit(conference).alias("conference"),
        "year",
        text("title").alias("title"),
        text("abstract").alias("abstract"),
        text(*TLDR_KEYS).alias("tldr"),
        _texts(content, "keywords").alias("keywords"),
        text(*AREA_KEYS).alias("primary_area"),
        _texts(content, "authors").alias("authors"),
        _texts(content, "authorids").alias("author_ids"),
        local.alias("pdf_path"),
        F.when(pdf != "", F.concat(F.lit(site), pdf)).otherwise("").alias("pdf_url"),
        note_decision(F.col("replies"), venue).alias("decision"),
        venue.alias("venue"),
        D.from_millis(F.col("cdate")).alias("creation_date"),
        D.from_millis(F.col("mdate")).alias("modification_date"),
    )


def plain_submission(notes: DataFrame, decision: Column) -> DataFrame:
    """The shorter form of a note, with the decision given: null for what is missing, title and abstract empty."""
    content = F.col("content")
    listed = lambda key: F.from_json(unwrap(content, key), "array<string>")
    return notes.select(
        "id",
        F.coalesce(unwrap(content, "title"), F.lit("")).alias("title"),
        F.coalesce(unwrap(content, "abstract"), F.lit("")).alias("abstract"),
        decision.alias("decision"),
        listed("authors").alias("authors"),
        listed("keywords").alias("keywords"),
        F.col("venue") if "venue" in notes.columns else F.lit(None).cast("string").alias("venue"),
        unwrap(content, "pdf").alias("pdf_url"),
        F.col("cdate").alias("created_date"),
        F.col("mdate").alias("modified_date"),
        first_filled(content, "TLDR", "tldr").alias("tldr"),
        unwrap(content, "primary_area").alias("primary_area"),
    )


def paper_rows(notes: DataFrame, submissions: DataFrame, markdown: DataFrame, pdfs: DataFrame) -> DataFrame:
    """A row a paper whose markdown is valid: submission as JSON with the abstract cleaned of links, reviews 1 to 12, meta-review,
    markdown raw, clean and by sections, and paths. notes(id, year, replies), markdown(id, path, value), pdfs(id, path)."""
    rows = submissions.join(markdown.select(F.col("id").alias("_id"), F.col("path").alias("md_path"), F.col("value").alias("raw_md")), F.col("id") == F.col("_id"))
    rows = rows.withColumn("clean_md", M.md_clean(F.col("raw_md"))).filter("clean_md is not null")
    rows = rows.join(notes.select(F.col("id").alias("_nid"), "replies"), F.col("id") == F.col("_nid"), "left").join(pdfs.select(F.col("id").alias("_pid"), F.col("path").alias("_pdf")), F.col("id") == F.col("_pid"), "left")
    row = F.struct(
        "id",
        "title",
        M.without_url_sentences(F.col("abstract")).alias("abstract"),
        F.col("abstract").alias("_original_abstract"),
        "decision",
        "authors",
        "keywords",
        "venue",
        "pdf_url",
        D.epoch_seconds(F.col("creation_date")).alias("created_date"),
        D.epoch_seconds(F.col("modification_date")).alias("modified_date"),
        "tldr",
        "primary_area",
    )
    rows = rows.withColumn("_reviews", note_reviews(F.col("replies"), F.col("year")))
    return rows.select(
        F.to_json(row, {"ignoreNullFields": "false"}).alias("submission"),
        note_meta(F.col("replies"), F.col("year"))["json"].alias("meta_review"),
        "raw_md",
        "clean_md",
        M.section_map(M.md_sections(F.col("clean_md"))).alias("clean_md_sections"),
        "md_path",
        F.col("_pdf").alias("pdf_path"),
        *reviews_columns(F.col("_reviews")),
    )


def with_split(rows: DataFrame, splits: DataFrame, contaminated: DataFrame, key: str = "submission_id") -> DataFrame:
    """Split of splits(key, split) and deepreview_split and deepreview_row_index of contaminated(key, label, first_index); empty and -1 if absent."""
    a = splits.select(F.col(key).alias("_a"), F.col("split").alias("_split"))
    b = contaminated.select(F.col(key).alias("_b"), F.col("label").alias("_label"), F.col("first_index").alias("_index"))
    out = rows.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    found = {"split": F.coalesce("_split", F.lit("")), "deepreview_split": F.coalesce("_label", F.lit("")), "deepreview_row_index": F.coalesce("_index", F.lit(-1))}
    return out.withColumns(found).drop("_a", "_b", "_split", "_label", "_index")


def is_image(content: Column) -> Column:
    """Whether bytes begin as PNG, JPEG, GIF or WebP do."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    return F.coalesce(head.rlike("^(89504E470D0A1A0A|FFD8FF|47494638|52494646.{8}57454250)"), F.lit(False))


def enriched(rows: DataFrame, texts: DataFrame, images: DataFrame, key: str = "submission_id") -> DataFrame:
    """Contents of the markdown files and images of rows(key, original_md_path, clean_md_path, images_in_clean_md,
    clean_pdf_img_paths). texts(path, value), images(path, content). Missing files give empty texts; images that are missing or
    aren't images are left out; malformed lists of paths count as empty. Images stay encoded."""
    held = texts.select(F.col("path").alias("_path"), F.col("value").alias("_value"))
    for name in ("original_md", "clean_md"):
        rows = rows.join(held, F.col(f"{name}_path") == F.col("_path"), "left").withColumn(f"{name}_content", F.coalesce("_value", F.lit(""))).drop("_path", "_value")
    files = images.filter(is_image(F.col("content"))).select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    named = F.map_entries(F.coalesce(F.from_json("images_in_clean_md", "map<string, string>"), F.create_map().cast("map<string, string>")))
    listed = F.transform(F.coalesce(F.from_json("clean_pdf_img_paths", "array<string>"), F.array().cast("array<string>")), lambda p: F.struct(F.lit(None).cast("string").alias("key"), p.alias("value")))
    for column, entries, item in (("md_images", named, F.struct(F.col("_name").alias("name"), F.col("_content").alias("image"))), ("pdf_page_images", listed, F.col("_content"))):
        each = rows.select(F.col(key).alias("_id"), F.posexplode(entries).alias("_at", "_e")).select("_id", "_at", F.col("_e.key").alias("_name"), F.col("_e.value").alias("_want"))
        met = each.join(files, F.col("_want") == F.col("_path")).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_at", item.alias("item")))).alias("_items"))
        empty = F.array().cast("array<struct<name: string, image: binary>>" if column == "md_images" else "array<binary>")
        rows = rows.join(met, F.col(key) == F.col("_id"), "left").withColumn(column, F.coalesce(F.transform("_items", lambda x: x["item"]), empty)).drop("_id", "_items")
    return rows


def canonical(rows: DataFrame) -> DataFrame:
    """The canonical columns in order and type; missing ones are an error, others go."""
    return rows.select(*[f.name for f in CANONICAL]).to(CANONICAL)


# --- predicates -----------------------------------------------------------------------------------------------------------


def complete_paper(decision: Column, markdown: Column) -> Column:
    """reviewable, and its markdown has an abstract and references."""
    return D.reviewable(decision) & F.coalesce(M.has_abstract_header(markdown) & M.has_references(markdown), F.lit(False))


def dataset_candidate(meta: Column, image_count: Column, decision: Column) -> Column:
    """with index data (struct has_abstract, page_end), an abstract, one image a page, and a reviewable decision."""
    return F.coalesce(meta.isNotNull() & meta["has_abstract"] & valid_images(image_count, meta["page_end"]) & D.reviewable(decision), F.lit(False))


def valid_reviews(reviews: Column, meta: Column) -> Column:
    """at least one review and a meta-review."""
    return (F.size(F.coalesce(reviews, F.array())) >= 1) & meta.isNotNull()


def with_prompts(rows: DataFrame, index: DataFrame, images: bool, key: str = "submission_id") -> DataFrame:
    """rows in the index; with images, only those of at least one image."""
    held = index.filter("image_count > 0") if images else index
    return rows.join(held.select(F.col("submission_id").alias("_held")), F.col(key) == F.col("_held"), "left_semi")


def found_versions(rows: DataFrame) -> DataFrame:
    """years whose API version was found."""
    return rows.filter("status = 'Found'")


def task_rows(rows: DataFrame, task: int, papers: bool = False) -> DataFrame:
    """rows that a prediction task can use: with a markdown path if papers are read, before 2026 for tasks 1, 2 and 7."""
    rows = rows.filter("md_path is not null") if papers else rows
    return rows.filter("year < 2026") if task in (1, 2, 7) else rows


def complete_submission(*columns: str) -> Column:
    """all columns are there."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def check_options(papers: bool = False, fewshot: bool = False, pct: float = 1.0, column: str = "Accepted") -> None:
    """options of a prediction run that exclude each other or are out of range."""
    if papers and fewshot:
        raise ValueError("papers and few-shot examples exclude each other")
    if not 0.0 < pct <= 1.0:
        raise ValueError(f"pct must be over 0 and at most 1, not {pct}")
    if column != "Accepted":
        raise ValueError(f"only the column Accepted can be predicted, not {column}")


def manifest_counters(rows: DataFrame) -> DataFrame:
    """(year, counter, n) of rows(year, decision, pdf_source): kept ones count by decision and by source, others by why they are skipped."""
    withdrawn, unknown = F.col("decision") == "Withdrawn", (F.col("decision") == "Unknown") & (F.col("year") != 2026)
    names = F.when(withdrawn, F.array(F.lit("skipped_withdrawn"))).when(unknown, F.array(F.lit("skipped_unknown"))).otherwise(F.array(F.col("decision"), F.concat(F.lit("source_"), F.coalesce("pdf_source", F.lit("None")))))
    return rows.select("year", F.explode(names).alias("counter")).groupBy("year", "counter").agg(F.count("*").alias("n"))


def sorted_entries(mapping: Column) -> Column:
    """Entries of a map in order of keys."""
    return F.array_sort(F.map_entries(mapping))


def bullet_list(items: Column) -> Column:
    """A line a text, as prompts list them."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


