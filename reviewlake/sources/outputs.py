"""Indices of outputs, plain writers, and plans of file moves (S7, S11, S13-S17, S22, S25-S27, T26). Nothing here moves files:
assignments and (old, new) path pairs are tables for a copying tool."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.splits import chunk, row_index
from reviewlake.sources.compaction import compact

# The fields that the index takes from a paper's meta file, with their defaults; PDFs of a batch; a table's header.
META = "has_abstract boolean, has_references boolean, page_end int, original_pdf_path string, anonymized_abstract string, removed_before_intro_count int, removed_footnotes_count int, removed_reproducibility_count int, removed_acknowledgments_count int, removed_github_in_abstract boolean, headers_whiteout_count int"
BATCH_FILES = 2200
CARD_HEADER = ("| Year | Reviewable | Complete | % | Reject | Poster | Spotlight | Oral |", "|------|-----------|----------|---|--------|--------|-----------|------|")


def normalized_index(files: DataFrame, metas: DataFrame) -> DataFrame:
    """(submission_id, pdf, meta_path, image_count, meta) of the folders <year>/<submission_id>/ that files(path) show.

    metas(path, value) holds the text of the meta files; meta is a struct of 11 fields with their defaults, null without a file
    or if it isn't JSON."""
    folder = r"/\d{4}/([^/]+)/"
    sid, name = F.regexp_extract("path", folder, 1), F.regexp_extract("path", r"([^/]+)$", 1)
    pdf, meta, image = name == F.concat(sid, F.lit(".pdf")), name == F.concat(sid, F.lit("_meta.json")), F.col("path").rlike(r"/redacted_pdf_img_content/page_[^/]*\.png$")
    direct = F.col("path").rlike(folder + "[^/]+$")
    found = files.withColumn("submission_id", sid).filter("submission_id != ''")
    found = found.groupBy("submission_id").agg(F.bool_or(pdf & direct).alias("pdf"), F.min(F.when(meta & direct, F.col("path"))).alias("meta_path"), F.count_if(image).alias("image_count"))
    held = metas.select(F.col("path").alias("_path"), F.from_json("value", META).alias("_m"), F.get_json_object("value", "$").isNotNull().alias("_json"))
    default = {"boolean": F.lit(False), "int": F.lit(0)}
    fields = [f.split() for f in META.split(", ")]
    whole = F.struct(*[F.coalesce(F.col(f"_m.{n}"), default.get(kind, F.lit("") if n == "anonymized_abstract" else F.lit(None).cast("string"))).alias(n) for n, kind in fields])
    return found.join(held, F.col("meta_path") == F.col("_path"), "left").withColumn("meta", F.when(F.col("_json"), whole)).drop("_path", "_m", "_json")


def load_citations(spark: SparkSession, source: str, conference: str = "iclr", by: str | None = None, parts: int = 16) -> DataFrame:
    """(id, normalized_title, gs_citation, pos) of a conference's papers, from Parquet or a JDBC address; filter and columns reach the
    source. by names a numeric column of a JDBC table, over whose range in the source the scan is dealt to parts connections."""
    if source.startswith("jdbc:"):
        table = spark.read.format("jdbc").option("url", source)
        if by is not None:
            rows = table.option("dbtable", "papers").load().filter(F.col("conference") == conference)
            least, most = rows.agg(F.min(by), F.max(by)).first()  # one row, computed in the source
            if least is not None:
                table = table.option("partitionColumn", by).option("lowerBound", str(least)).option("upperBound", str(most + 1)).option("numPartitions", str(parts))
        rows = table.option("dbtable", "papers").load()
        rows = rows.toDF(*[c.lower() for c in rows.columns])
    else:
        rows = spark.read.parquet(source)
    return rows.filter(F.col("conference") == conference).select("id", "normalized_title", "gs_citation", *(["pos"] if "pos" in rows.columns else [F.lit(0).alias("pos")]))


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Prompt rows as Parquet, for load_prompts."""
    prompts.write.mode("overwrite").parquet(path)


def load_prompts(spark: SparkSession, path: str, shard: int = 0, shards: int = 1) -> DataFrame:
    """Prompt rows, of a shard those that the hash of their key deals to it."""
    rows = spark.read.parquet(path)
    return rows if shards == 1 else rows.filter(F.pmod(F.xxhash64("submission_id", "type", "review_index"), F.lit(shards)) == shard)


def write_parts(df: DataFrame, path: str, parts: int) -> None:
    """Parquet in so many files."""
    df.repartition(parts).write.mode("overwrite").parquet(path)


def merge_shards(spark: SparkSession, paths: str | list[str], out: str, shards: int | None = None, bound: int = 1 << 30) -> DataFrame:
    """The shards under a folder (or several) as files of at most bound bytes; the table of moves. With shards it also lists
    those of shard_00, shard_01, ... that are missing in the first folder."""
    return compact(spark, paths, out, bound, None if shards is None else [f"shard_{i:02d}" for i in range(shards)])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled; every character of a text stays, as read_csv reads it back."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def batch_assignment(files: DataFrame, order: str = "path", size: int = BATCH_FILES) -> DataFrame:
    """files(path) with the batch (batch_00, ...) and the link's path in it."""
    rows = row_index(files, order)
    batch = F.concat(F.lit("batch_"), F.lpad(chunk(F.col("row_index"), size).cast("string"), 2, "0"))
    batch = F.when(F.col("row_index") >= 100 * size, F.concat(F.lit("batch_"), chunk(F.col("row_index"), size).cast("string"))).otherwise(batch)
    return rows.withColumn("batch", batch).withColumn("link", F.concat_ws("/", "batch", F.regexp_extract("path", r"([^/]+)$", 1))).drop("row_index")


def merged_outputs(outputs: DataFrame, pdfs: DataFrame, existing: DataFrame) -> DataFrame:
    """(stem, batch, year) of outputs(stem, batch) to copy: the year of pdfs(stem, year), of a stem in several batches the first,
    and none that existing(stem, year) has."""
    years = pdfs.groupBy(F.col("stem").alias("_stem")).agg(F.max("year").alias("year"))
    rows = outputs.groupBy("stem").agg(F.min("batch").alias("batch")).join(years, F.col("stem") == F.col("_stem")).drop("_stem")
    return rows.join(existing, ["stem", "year"], "left_anti").select("stem", "batch", "year")


def pdf_copies(files: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """(old_path, new_path) of files(path) <id>.pdf to copy as <id>_.pdf, but for those that existing(path) has."""
    rows = files.filter("path like '%.pdf'").select(F.col("path").alias("old_path"), F.concat(F.lit(folder + "/"), F.regexp_extract("path", r"([^/]+)\.pdf$", 1), F.lit("_.pdf")).alias("new_path"))
    return rows.join(existing.select(F.col("path").alias("new_path")), "new_path", "left_anti").select("old_path", "new_path")


def redacted_pdfs(pdfs: DataFrame) -> DataFrame:
    """pdfs(submission_id, content, boxes ARRAY<STRUCT<page int, box ARRAY<DOUBLE>>>, page_end) with the boxes (in points, see
    to_points) whited out and pages after page_end cut. Needs the optional package pymupdf on the executors; an unreadable PDF gives null and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for pdf in batches:
            out = []
            for sid, content, boxes, last in zip(pdf["submission_id"], pdf["content"], pdf["boxes"], pdf["page_end"]):
                try:
                    with pymupdf.open(stream=content, filetype="pdf") as doc:
                        for b in boxes if boxes is not None else ():
                            if b["page"] < len(doc):
                                doc[b["page"]].add_redact_annot(pymupdf.Rect(*b["box"]), fill=(1, 1, 1))
                        for page in doc:
                            page.apply_redactions()
                        if 0 <= last < len(doc) - 1:
                            doc.select(range(last + 1))
                        out.append((sid, doc.tobytes(), None))
                except Exception as e:  # a broken PDF is a result, not a failure of the job
                    out.append((sid, None, str(e)))
            yield pd.DataFrame(out, columns=["submission_id", "content", "error"])

    return pdfs.select("submission_id", "content", "boxes", "page_end").mapInPandas(run, "submission_id string, content binary, error string")


def card_rows(coverage: DataFrame, complete: DataFrame) -> DataFrame:
    """(year, line) of the dataset card's table; the total has a null year. coverage(year, reviewable, reject, poster, spotlight,
    oral) with one row a year, complete(year, n)."""
    held = coverage.join(complete.select(F.col("year").alias("_y"), F.col("n").alias("_n")), F.col("year") == F.col("_y"), "left").withColumn("complete", F.coalesce("_n", F.lit(0)))
    sums = held.rollup("year").agg(*[F.sum(c).alias(c) for c in ("reviewable", "complete", "reject", "poster", "spotlight", "oral")])
    share = F.when(F.col("reviewable") > 0, F.bround(100.0 * F.col("complete") / F.col("reviewable"), 1).cast("string")).otherwise("0")
    cells = [F.coalesce(F.col("year").cast("string"), F.lit("Total")), F.format_number("reviewable", 0), F.format_number("complete", 0), F.concat(share, F.lit("%")), *[F.format_number(c, 0) for c in ("reject", "poster", "spotlight", "oral")]]
    bold = lambda c: F.when(F.col("year").isNull(), F.concat(F.lit("**"), c, F.lit("**"))).otherwise(c)
    return sums.select("year", F.concat(F.lit("| "), F.concat_ws(" | ", *map(bold, cells)), F.lit(" |")).alias("line"))


def card_table(rows: DataFrame) -> str:
    """The table as text, from card_rows(); a line a year."""
    return "\n".join([*CARD_HEADER, *[r["line"] for r in rows.orderBy(F.col("year").asc_nulls_last()).collect()]])


def output_path(folder: str, task: int, model: str, version: str, fewshot: bool = False, papers: bool = False, pct: float = 1.0, dry_run: bool = False) -> str:
    """The folder of a prediction run, by model and variant."""
    from reviewlake.functions.text import model_folder

    variant = f"task{task}_{version}" + ("_fewshot" if fewshot else "_paper" if papers else "") + (f"_pct{int(pct * 100)}" if pct < 1.0 else "")
    return "/".join([folder, model_folder(model), *(["dry_run"] if dry_run else []), variant])


