"""Rows put together from many tables (J10), legacy flat rows (P11), holdouts and files of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import remove_git_sentences
from reviewlake.operators.notes import AREA_KEYS, technical_indicators, unwrap

# The meta-review's names in the older API, by preference; endings of image files.
META_KEYS = ("metareview:_summary,_strengths_and_weaknesses", "metareview")
IMAGE_PATTERN = r"(?i)\.(png|jpg|jpeg)$"


def _first(replies: Column, test) -> Column:
    return F.get(F.filter(F.coalesce(replies, F.array()), test), F.lit(0))


def _iso(millis: Column) -> Column:
    """A time as ISO text of the session's zone, with six decimals unless they are 0; empty for none or 0."""
    at = F.timestamp_millis(millis)
    return F.when(millis != 0, F.when(millis % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).otherwise("")


def _plain(content: Column) -> Column:
    """All values of a content, unwrapped."""
    return F.map_from_arrays(F.map_keys(content), F.transform(F.map_keys(content), lambda k: unwrap(content, k)))


def legacy_row(notes: DataFrame, conference: str, api: int, revisions: Column | None = None) -> DataFrame:
    """16 text columns a note(id, year, cdate, mdate, content, replies) of API 1 or 2; missing texts are empty, missing lists `[]`.

    API 1 knows reviews by the end of their invitation and takes the meta-review from the decision; API 2 by any invitation
    that holds the word, and takes it from the first meta-review.
    """
    content, replies = F.col("content"), F.col("replies")

    def has(r: Column, *words: str) -> Column:
        pattern = "|".join(words)
        held = r["invitation"].rlike(pattern) if api == 1 else F.exists(r["invitations"], lambda i: i.rlike(pattern))
        return F.coalesce(held, F.lit(False))

    def text(*keys: str, of: Column = content, default: str = "") -> Column:
        return F.coalesce(*[unwrap(of, k) for k in keys], F.lit(default))

    review = (lambda r: F.coalesce(F.endswith(r["invitation"], F.lit("Official_Review")), F.lit(False))) if api == 1 else (lambda r: has(r, "Official_Review"))
    reviews = F.transform(F.filter(F.coalesce(replies, F.array()), review), lambda r: F.struct(r["id"].alias("id"), _plain(r["content"]).alias("content")))
    decision = _first(replies, lambda r: has(r, "Decision"))
    meta = text(*META_KEYS, of=decision["content"]) if api == 1 else text("metareview", of=_first(replies, lambda r: has(r, "Meta_Review"))["content"])
    author = _first(replies, lambda r: has(r, *(("Rebuttal", "Author") if api == 1 else ("Rebuttal",))))
    return notes.select(
        F.lit(conference).alias("conference"),
        "year",
        F.col("id").alias("submission_id"),
        text("title").alias("title"),
        text("abstract").alias("abstract"),
        text("keywords", default="[]").alias("keywords"),
        text("authors", default="[]").alias("authors"),
        _iso(F.col("cdate")).alias("publish_date"),
        _iso(F.col("mdate")).alias("last_modified_date"),
        text("supplementary_material").alias("supplemental_link"),
        text(AREA_KEYS[1] if api == 1 else AREA_KEYS[0]).alias("primary_area"),
        F.to_json(reviews).alias("reviewer_response_json"),
        text("decision", of=decision["content"]).alias("paper_decision"),
        meta.alias("meta_review"),
        F.coalesce(F.to_json(_plain(author["content"])), F.lit("{}")).alias("author_main_response"),
        (F.lit("[]") if revisions is None else F.coalesce(revisions, F.lit("[]"))).alias("revisions_json"),
    )


def image_paths(files: DataFrame, folder: str) -> DataFrame:
    """(submission_id, images MAP<name, path>, paths ARRAY) of the image files in <submission_id>/<folder>/, in order of names as text."""
    rows = files.filter(F.col("path").rlike(IMAGE_PATTERN)).select(F.regexp_extract("path", rf"/([^/]+)/{folder}/[^/]+$", 1).alias("submission_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path").filter("submission_id != ''")
    held = rows.groupBy("submission_id").agg(F.sort_array(F.collect_set(F.struct("name", "path"))).alias("held"))
    return held.select("submission_id", F.map_from_entries("held").alias("images"), F.transform("held", lambda x: x["path"]).alias("paths"))


def load_holdout(spark: SparkSession, path: str, example: str = "id string") -> DataFrame:
    """(year, example) of a JSON file {year: [example, ...]}; the ids to leave out are example.id. A missing file gives no rows."""
    from pyspark.errors import AnalysisException

    schema = f"map<string, array<struct<{', '.join(f.replace(' ', ': ', 1) for f in example.split(', ')).strip()}>>>"
    empty = spark.createDataFrame([], f"year string, example {schema.removeprefix('map<string, array<').removesuffix('>>')}")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    years = text.select(F.explode(F.from_json("value", schema)).alias("year", "examples"))
    return years.select("year", F.explode("examples").alias("example"))


def without_holdout(rows: DataFrame, holdout: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't a holdout example's id."""
    return rows.join(holdout.select(F.col("example.id").alias("_held")).distinct(), F.col(key) == F.col("_held"), "left_anti")


def with_markdown_path(rows: DataFrame, files: DataFrame, year: str = "year", key: str = "id") -> DataFrame:
    """md_path, the path <year>/<id>/<id>.md if there is such a file, else null."""
    stem = F.regexp_extract("path", r"/(\d{4})/([^/]+)/\2\.md$", 2)
    held = files.select(F.regexp_extract("path", r"/(\d{4})/([^/]+)/\2\.md$", 1).try_cast("int").alias("_year"), stem.alias("_stem"), "path").filter("_stem != ''")
    held = held.groupBy("_year", "_stem").agg(F.min("path").alias("md_path"))
    return rows.join(held, (F.col(year) == F.col("_year")) & (F.col(key) == F.col("_stem")), "left").drop("_year", "_stem")


def submission_folders(ids: DataFrame, folders: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Year and path of each id's folder(year, id, path), of several years the first; strict raises on an id without one."""
    best = folders.groupBy(F.col(key).alias("_id")).agg(F.min(F.struct("year", "path")).alias("_b"))
    found = ids.join(best, F.col(key) == F.col("_id"), "left")
    path = F.col("_b.path")
    if strict:
        path = F.coalesce(path, F.raise_error(F.concat(F.lit("no folder of submission "), F.col(key))).cast("string"))
    return found.select(*[ids[c] for c in ids.columns], F.col("_b.year").alias("folder_year"), path.alias("folder"))


def pdf_backups(changed: DataFrame, files: DataFrame, year: int, backup: str) -> DataFrame:
    """(old_path, new_path) of superseded PDFs <year>/<submission_id>_<old_download_id>.pdf that exist; nothing is moved."""
    old = changed.filter("old_download_id != ''").select(F.concat_ws("_", "submission_id", "old_download_id").alias("_stem")).distinct()
    held = files.select(F.col("path").alias("old_path"), F.regexp_extract("path", rf"/{year}/([^/]+)\.pdf$", 1).alias("_stem"))
    new = F.regexp_replace("old_path", rf"/{year}/([^/]+)$", f"/{backup}/$1")
    return held.join(old, "_stem", "left_semi").select("old_path", new.alias("new_path"))


def normalized_reviews(rows: DataFrame) -> DataFrame:
    """(submission_id, reviews MAP<index, json>, meta) of rows(submission_id, type, review_index, normalized, pos); of several the last."""
    last = rows.groupBy("submission_id", "type", "review_index").agg(F.max_by("normalized", "pos").alias("normalized"))
    each = F.collect_list(F.when((F.col("type") == "review") & F.col("normalized").isNotNull(), F.struct("review_index", "normalized")))
    return last.groupBy("submission_id").agg(F.map_from_entries(each).alias("reviews"), F.max(F.when(F.col("type") == "meta", F.col("normalized"))).alias("meta"))


def assemble(notes: DataFrame, normalized: DataFrame, manifest: DataFrame, layouts: DataFrame, markdown: DataFrame, changes: DataFrame, images: DataFrame, page_images: DataFrame, contents: DataFrame, citations: DataFrame, site: str, root: str) -> DataFrame:
    """One row of 22 columns a note; all other tables are joined by submission_id, of which each has at most one row.

    notes(submission_id, year, title, abstract, decision, ratings, reviews ARRAY, meta), normalized as normalized_reviews() gives,
    manifest(pdf_path), layouts(path, md_path), markdown(path), changes(meta_json), images and page_images as image_paths()
    gives, contents(content_list), citations(gs_citation). Normalised reviews are there only if all of a note's are.
    """
    renamed = [
        normalized.select("submission_id", F.col("reviews").alias("_norm"), F.col("meta").alias("_norm_meta")),
        manifest.select("submission_id", F.col("pdf_path").alias("_pdf")),
        layouts.select("submission_id", F.col("path").alias("_layout"), F.col("md_path").alias("_layout_md")),
        markdown.select("submission_id", F.col("path").alias("_md")),
        changes.select("submission_id", F.col("meta_json").alias("_changes")),
        images.select("submission_id", F.col("images").alias("_images")),
        page_images.select("submission_id", F.col("paths").alias("_pages")),
        contents.select("submission_id", F.col("content_list").alias("_contents")),
        citations.select("submission_id", F.col("gs_citation").alias("_cited")),
    ]
    rows = notes
    for side in renamed:
        rows = rows.join(side, "submission_id", "left")
    reviews, empty = F.coalesce("reviews", F.array()), F.lit("")
    each = F.transform(reviews, lambda r, i: F.element_at(F.col("_norm"), i))
    whole = (F.size(reviews) > 0) & F.coalesce(F.forall(each, lambda x: x.isNotNull()), F.lit(False))
    indicators = technical_indicators(F.col("decision"), F.col("_cited"), F.col("ratings"))
    return rows.select(
        "submission_id",
        "year",
        F.concat(F.lit(f"{site}/forum?id="), "submission_id").alias("openreview_link"),
        F.when(F.col("_pdf") != "", F.concat(F.lit(site), "_pdf")).otherwise(empty).alias("pdf_download_link"),
        "title",
        F.col("abstract").alias("original_abstract"),
        remove_git_sentences(F.col("abstract")).alias("no_github_abstract"),
        F.coalesce("_layout_md", empty).alias("original_md_path"),
        F.coalesce("_md", empty).alias("clean_md_path"),
        F.coalesce(F.to_json("_images"), F.lit("{}")).alias("images_in_clean_md"),
        F.coalesce(F.to_json("_pages"), F.lit("[]")).alias("clean_pdf_img_paths"),
        F.to_json(reviews).alias("original_reviews"),
        F.when(whole, F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))).alias("normalized_reviews"),
        F.when(F.col("year") < 2026, F.to_json("meta")).alias("original_metareview"),
        F.col("_norm_meta").alias("normalized_metareview"),
        F.to_json(indicators).alias("technical_indicators"),
        F.coalesce("_changes", F.lit("{}")).alias("metadata_of_changes"),
        F.to_json(F.struct(*[notes[c] for c in notes.columns if c not in ("reviews", "meta")])).alias("submission_json"),
        F.coalesce("_contents", F.lit("[]")).alias("content_list_json"),
        F.coalesce(F.get_json_object("_changes", "$.original_pdf_path"), empty).alias("_pdf_path"),
        F.coalesce("_layout", empty).alias("_mineru_path"),
        F.concat_ws("/", F.lit(root), F.col("year").cast("string"), "submission_id").alias("_normalized_path"),
    )
