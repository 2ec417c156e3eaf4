"""Queries that write whole tables through the sinks and read them back through the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import markdown as M
from reviewlake.operators import assembly as A
from reviewlake.plans.funnel import PAPERS_SQL, papers
from reviewlake.plans.registry import query
from reviewlake.session import scratch
from reviewlake.sources import files as IO
from reviewlake.sources import outputs as O
from reviewlake.sources import versions as V


@query("notes_scanned", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 2022 ELSE 2021 END AS year, text FROM documents WHERE doc_id % 4 < 3 OR doc_id % 3 = 0")
def notes_scanned(load):
    """Notes by year; an id of several years is the latest one's, and years that aren't asked for don't count."""
    d, key = load("documents"), F.col("doc_id").cast("string").alias("id")
    rows = d.filter("doc_id % 4 < 3").select(key, F.lit(2021).alias("year"), "text").unionByName(d.filter("doc_id % 3 = 0").select(key, F.lit(2022).alias("year"), "text")).unionByName(d.select(key, F.lit(2026).alias("year"), F.lit("late").alias("text")))
    path = scratch(d.sparkSession, "notes")
    IO.write_by(rows, path, "year")
    return IO.load_notes(d.sparkSession, path, [2021, 2022, 2023])


#: Bytes of a split in the queries that read CSV back, far below a table's size, so that texts and records cross splits.
SPLIT_BYTES = 65_536


def _manifest(load, name: str) -> tuple:
    """Paths of a manifest whose titles are whole texts, and of a later one that repeats every seventh id."""
    p = papers(load)
    blank = [F.lit("").alias(n) for n in ("pdf_path", "pdf_hash", "pdf_source", "download_id")]
    rows = p.select(F.col("submission_id").cast("string").alias("submission_id"), "year", "decision", *blank, F.concat(F.lit('"1,"\n'), F.col("text")).alias("title"))
    path = scratch(p.sparkSession, name)
    O.write_csv(rows, f"{path}/a")
    O.write_csv(rows.filter("submission_id % 7 = 0").withColumn("decision", F.lit("Later")), f"{path}/b")
    return p.sparkSession, [f"{path}/a", f"{path}/b"]


@query("manifest_csv", f"WITH {PAPERS_SQL} SELECT submission_id::VARCHAR AS submission_id, year, CASE WHEN submission_id % 7 = 0 THEN 'Later' ELSE decision END AS decision, '\"1,\"' || chr(10) || text AS title FROM papers")
def manifest_csv(load):
    """Whole texts with quotes, commas and line ends, read back by small splits; of repeated ids the last row."""
    spark, paths = _manifest(load, "manifest")
    return IO.load_manifest(spark, paths, split_bytes=SPLIT_BYTES).select("submission_id", "year", "decision", "title")


@query("manifest_year", f"WITH {PAPERS_SQL} SELECT submission_id::VARCHAR AS submission_id, d AS decision, text AS title FROM papers, (VALUES ('first'), ('Later')) v(d) WHERE year = 2023 AND (d = 'first' OR submission_id % 7 = 0)")
def manifest_year(load):
    """All rows of a year."""
    spark, paths = _manifest(load, "manifest_year")
    rows = IO.load_manifest(spark, paths, 2023, SPLIT_BYTES)
    return rows.select("submission_id", F.when(F.col("decision") == "Later", "Later").otherwise("first").alias("decision"), F.expr("substring(title, 6)").alias("title"))


@query("completion_files", "SELECT conv_id, count(*) AS n, count(DISTINCT turn % 3) AS shards FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def completion_files(load):
    """Batches of completions, read by a pattern; empty ones go."""
    c = load("conversations")
    path = scratch(c.sparkSession, "completions")
    for i in range(3):
        O.write_prompts(c.filter(F.col("turn") % 3 == i).select("conv_id", F.lit(i).alias("shard"), F.col("text").alias("normalized_json")), f"{path}/batch_{i}/normalized.parquet")
    return IO.load_completions(c.sparkSession, f"{path}/batch_*/normalized.parquet").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards"))


@query(
    "labelled_csv_rows",
    """WITH u AS (SELECT doc_id AS id, text AS name, 'train' AS label, 0 AS o FROM documents UNION ALL SELECT c_custkey, c_name, 'test', 1 FROM customer UNION ALL SELECT s_suppkey, s_name, 'test_2', 2 FROM supplier)
SELECT id::VARCHAR AS id, label, name, (row_number() OVER (ORDER BY o, id) - 1)::BIGINT AS row_index FROM u""",
)
def labelled_csv_rows(load):
    """Labelled CSVs of several files and many splits; each row's index is its place in file order."""
    tables = {"train": load("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name")), "test": load("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "test_2": load("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    spark = tables["train"].sparkSession
    path = scratch(spark, "labelled")
    for label, rows in tables.items():
        O.write_csv(rows.select("name", "id", F.lit("x").alias("unused")).repartitionByRange(3, "id").sortWithinPartitions("id"), f"{path}/{label}")
    return IO.labelled_csvs(spark, {label: f"{path}/{label}" for label in tables}, ["id", "name"], SPLIT_BYTES)


@query("chunked_files", "SELECT 'rows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'keys', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'files over 1000 rows', 0")
def chunked_files(load):
    """Files of at most 1000 rows hold every row."""
    orders = load("orders")
    path = scratch(orders.sparkSession, "chunks")
    IO.write_chunks(orders, path)
    rows = orders.sparkSession.read.parquet(path)
    over = rows.groupBy(F.input_file_name().alias("f")).count().filter("count > 1000")
    counts = {"rows": rows.agg(F.count("*").alias("n")), "keys": rows.agg(F.count_distinct("o_orderkey").alias("n")), "files over 1000 rows": over.agg(F.count("*").alias("n"))}
    return reduce(DataFrame.unionByName, [one.select(F.lit(what).alias("what"), "n") for what, one in counts.items()])


def _merged(load, name: str) -> tuple:
    """Seven shards of lineitem, of which number 3 is missing, merged into files of a bounded size: the folder and the table of moves."""
    rows = load("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    path = scratch(rows.sparkSession, name)
    for i in (0, 1, 2, 4, 5, 6):
        O.write_parts(rows.filter(F.col("l_orderkey") % 7 == i), f"{path}/in/shard_{i:02d}", 1 + i % 3)
    return rows.sparkSession, path, O.merge_shards(rows.sparkSession, f"{path}/in", f"{path}/out", 7, SHARD_BYTES)


#: Bound of the merged files: some of the shards' files are larger, most far smaller.
SHARD_BYTES = 40_000


@query("merged_shards", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 3")
def merged_shards(load):
    """All rows of the shards, from files of a bounded size."""
    spark, path, _ = _merged(load, "shards")
    return spark.read.parquet(f"{path}/out")


@query("shard_moves", "SELECT 'shard_' || lpad(k::VARCHAR, 2, '0') AS shard, CASE WHEN k = 3 THEN 0 ELSE n END::BIGINT AS n_rows, k = 3 AS missing, 0::BIGINT AS files_over FROM (SELECT l_orderkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def shard_moves(load):
    """Where each shard's rows went, which shards are missing, and that no bin passes the bound."""
    _, _, moves = _merged(load, "moves")
    over = moves.groupBy("file_bin").agg(F.sum("bytes").alias("b")).filter(F.col("b") > SHARD_BYTES).agg(F.count("*").alias("files_over"))
    return moves.groupBy(F.regexp_extract("path", r"(shard_\d+)", 1).alias("shard")).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.bool_or("missing").alias("missing")).crossJoin(F.broadcast(over))


@query("replaced_folders", f"WITH {PAPERS_SQL} SELECT year, CASE WHEN year = 2021 THEN 'new' ELSE decision END AS decision, count(*) AS n FROM papers GROUP BY ALL")
def replaced_folders(load):
    """One folder a value; writing one again leaves the others."""
    p = papers(load).select("submission_id", "year", "decision")
    path = scratch(p.sparkSession, "folders")
    IO.write_by(p, path, "year")
    IO.write_by(p.filter("year = 2021").withColumn("decision", F.lit("new")), path, "year")
    return p.sparkSession.read.parquet(path).groupBy("year", "decision").agg(F.count("*").alias("n"))


@query("replaced_parts", f"WITH {PAPERS_SQL} SELECT year, CASE WHEN year = 2021 THEN 'new' ELSE decision END AS decision, text FROM papers WHERE year <> 2022")
def replaced_parts(load):
    """Parts of a table replaced by commits; a part that gets no rows goes, and readers see the last commit."""
    p = papers(load).select("submission_id", "year", "decision", "text")
    path = scratch(p.sparkSession, "parts")
    V.replace_parts(p, path, "year")
    V.replace_parts(p.filter("year = 2021").withColumn("decision", F.lit("new")), path, "year", [2021, 2022])
    return V.read_parts(p.sparkSession, path, "submission_id long, year int, decision string, text string").select("year", "decision", "text")


@query("citations_scanned", "SELECT p_partkey AS pos, p_name AS normalized_title, p_size::BIGINT AS gs_citation FROM part WHERE p_partkey % 3 > 0")
def citations_scanned(load):
    """One conference's papers; the filter and the columns reach the files."""
    part = load("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("normalized_title"), F.col("p_size").cast("long").alias("gs_citation"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 > 0, "iclr").otherwise("other").alias("conference"), F.lit("unused").alias("more"))
    path = scratch(part.sparkSession, "papers")
    part.write.parquet(path)
    return O.load_citations(part.sparkSession, path).select("pos", "normalized_title", "gs_citation")


@query("holdout_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id * 3 FROM benchmark)")
def holdout_rows(load):
    """Rows but for the examples of a JSON file by year."""
    items = load("benchmark").select((F.col("item_id") * 3).cast("string").alias("id"), F.col("text").alias("title"))
    path = scratch(items.sparkSession, "holdout")
    whole = items.agg(F.to_json(F.create_map(F.lit("2024"), F.collect_list(F.struct("id", "title")))).alias("value"))  # the holdout is a list of examples, small by nature
    whole.coalesce(1).write.text(path)
    held = A.load_holdout(items.sparkSession, path, "id string, title string")
    return A.without_holdout(load("documents").select(F.col("doc_id").cast("string").alias("id")), held).select(F.col("id").cast("long").alias("doc_id"))


@query("plain_abstracts", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(replace(text, '#', ''), ' ') ELSE left('No header ' || text, 2000) END AS abstract FROM documents WHERE length(trim(replace(text, '#', ''), ' ')) > 0")
def plain_abstracts(load):
    """T23."""
    body = F.replace(F.col("text"), F.lit("#"), F.lit(""))
    md = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Title\n## Abstract\n"), body, F.lit("\n# 1 Introduction\nmore"))).otherwise(F.concat(F.lit("No header "), F.col("text")))
    return load("documents").filter(F.length(F.trim(body)) > 0).select("doc_id", M.extract_abstract_plain(md).alias("abstract"))
