"""Queries of the funnel, coverage and manipulation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.plans.registry import query

PAPERS_SQL = """papers AS (
  SELECT d.doc_id AS submission_id, (2020 + d.doc_id % 7)::INTEGER AS year, d.text, d.n_chars,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Poster' WHEN l.quality = 1 THEN 'Spotlight' WHEN l.toxic = 1 THEN 'Withdrawn' WHEN l.quality = 0 THEN 'Reject' ELSE 'Unknown' END AS decision,
    d.lang
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def papers(load):
    """Documents in the role of submissions: a year, and a decision from their labels."""
    joined = load("documents").join(load("labels"), "doc_id", "left")
    decision = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Poster").when(F.col("quality") == 1, "Spotlight").when(F.col("toxic") == 1, "Withdrawn").when(F.col("quality") == 0, "Reject").otherwise("Unknown")
    )
    return joined.select(F.col("doc_id").alias("submission_id"), (2020 + F.col("doc_id") % 7).cast("int").alias("year"), "text", "n_chars", decision.alias("decision"), "lang")

from reviewlake.functions import decisions as D  # noqa: E402
from reviewlake.operators import statistics as S  # noqa: E402

STAGES = {
    "reviewable": lambda: D.reviewable(F.col("decision")),
    "has_pdf": lambda: F.col("n_chars") > 50,
    "layout": lambda: F.col("n_chars") > 200,
    "valid_md": lambda: F.col("n_chars") > 400,
    "has_abs_ref": lambda: F.col("lang") == "en",
    "images": lambda: F.col("submission_id") % 10 != 3,
    "valid_reviews": lambda: F.col("decision") != "Unknown",
}
FUNNEL_SQL = f"""WITH {PAPERS_SQL}, s AS (SELECT *, decision NOT IN ('Withdrawn', 'Desk Reject') AS s1, n_chars > 50 AS s2, n_chars > 200 AS s3, n_chars > 400 AS s4, lang = 'en' AS s5, submission_id % 10 <> 3 AS s6, decision <> 'Unknown' AS s7 FROM papers),
c AS (SELECT year, count(*) AS total, count_if(s1) AS reviewable, count_if(s1 AND s2) AS has_pdf, count_if(s1 AND s2 AND s3) AS layout, count_if(s1 AND s2 AND s3 AND s4) AS valid_md,
  count_if(s1 AND s2 AND s3 AND s4 AND s5) AS has_abs_ref, count_if(s1 AND s2 AND s3 AND s4 AND s5 AND s6) AS images, count_if(s1 AND s2 AND s3 AND s4 AND s5 AND s6 AND s7) AS valid_reviews
  FROM s GROUP BY ROLLUP (year))
SELECT *, CASE WHEN reviewable > 0 THEN round_even(100.0::DOUBLE * valid_reviews / reviewable, 1) END AS pct_of_reviewable FROM c"""


@query("funnel_by_year", FUNNEL_SQL)
def funnel_by_year(load):
    """A1, A2: cumulative stages by year and in total."""
    out = S.funnel(papers(load), "year", {k: v() for k, v in STAGES.items()})
    return out.withColumn("pct_of_reviewable", D.percent(F.col("valid_reviews"), F.col("reviewable")))


@query(
    "coverage_by_decision",
    f"""WITH {PAPERS_SQL} SELECT year, count(*) AS total, count_if(decision = 'Poster') AS poster, count_if(decision = 'Spotlight') AS spotlight, count_if(decision = 'Reject') AS reject,
  count_if(decision = 'Withdrawn') AS withdrawn, count_if(decision = 'Unknown') AS unknown, count_if(contains(text, '#')) AS with_header FROM papers GROUP BY ROLLUP (year)""",
)
def coverage_by_decision(load):
    """A4-A6."""
    flags = {d.lower(): F.col("decision") == d for d in ("Poster", "Spotlight", "Reject", "Withdrawn", "Unknown")}
    return S.flag_counts(papers(load), "year", flags | {"with_header": F.contains("text", F.lit("#"))})


@query(
    "complete_papers",
    f"""WITH {PAPERS_SQL} SELECT year, decision, count(*) AS n, sum(count(*)) OVER (PARTITION BY year)::BIGINT AS of_year FROM papers
  WHERE decision NOT IN ('Withdrawn', 'Desk Reject') AND text IS NOT NULL AND submission_id % 4 > 0 AND n_chars % 3 > 0 GROUP BY year, decision""",
)
def complete_papers(load):
    """A5, F2."""
    from pyspark.sql import Window

    from reviewlake.operators.submissions import complete_paper

    md = F.concat(F.when(F.col("submission_id") % 4 > 0, "# Abstract\n").otherwise(""), F.translate("text", "#", ""), F.when(F.col("n_chars") % 3 > 0, "\n\n## REFERENCES\n[1]").otherwise(""))
    kept = papers(load).filter(complete_paper(F.col("decision"), md))
    return S.value_counts(kept, "year", "decision").withColumn("of_year", F.sum("n").over(Window.partitionBy("year")))


@query(
    "manipulation_stats",
    f"""WITH {PAPERS_SQL} SELECT year, count(*) AS total, count_if(contains(text, '**')) AS bold, count_if(contains(text, '|')) AS tables, count_if(contains(lower(text), 'license')) AS license, count_if(contains(text, '%%%')) AS noise
  FROM papers GROUP BY ROLLUP (year)""",
)
def manipulation_stats(load):
    """A3."""
    t = F.col("text")
    has = lambda w, c=t: F.contains(c, F.lit(w))
    return S.flag_counts(papers(load), "year", {"bold": has("**"), "tables": has("|"), "license": has("license", F.lower(t)), "noise": has("%%%")})


@query(
    "violation_subsets",
    f"""WITH {PAPERS_SQL}, f AS (SELECT *, contains(text, '#') AS a, contains(text, '**') AS b, contains(lower(text), 'license') AS c FROM papers)
SELECT year, decision, CASE WHEN NOT (a OR b OR c) THEN 'none' ELSE concat_ws('+', CASE WHEN a THEN 'header' END, CASE WHEN b THEN 'bold' END, CASE WHEN c THEN 'license' END) END AS subset, count(*) AS n, min(submission_id) AS example
FROM f GROUP BY ALL""",
)
def violation_subsets(load):
    """A7, N9."""
    t = F.col("text")
    return S.subset_cells(papers(load), {"header": F.contains(t, F.lit("#")), "bold": F.contains(t, F.lit("**")), "license": F.contains(F.lower(t), F.lit("license"))}, ["year", "decision"], "submission_id")


@query("review_averages", "SELECT o_orderstatus AS status, count(DISTINCT l_orderkey) AS papers, count(*) AS reviews, round(count(*)::DOUBLE / count(DISTINCT l_orderkey), 6) AS average FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def review_averages(load):
    """A2, A10: children in all and on average, from per-parent counts."""
    found = S.child_averages(load("orders").withColumnRenamed("o_orderstatus", "status"), load("lineitem"), "o_orderkey", "l_orderkey", "status")
    return found.withColumn("average", F.round("average", 6))


@query("value_counts", f"WITH {PAPERS_SQL} SELECT year, decision, count(*) AS n FROM papers GROUP BY ALL")
def value_counts(load):
    """A9."""
    return S.value_counts(papers(load), "year", "decision")


@query(
    "key_presence",
    """WITH k AS (SELECT DISTINCT month(ts) AS m, unnest(json_keys(props)) AS key FROM events), g AS (SELECT count(DISTINCT month(ts)) AS n FROM events)
SELECT key, count(*) AS n_groups, min(m)::INTEGER AS first_group, max(m)::INTEGER AS last_group, count(*) = (SELECT n FROM g) AS in_all FROM k GROUP BY key""",
)
def key_presence(load):
    """A11."""
    return S.key_presence(load("events").withColumn("m", F.month("ts")), "m", F.json_object_keys("props"))


@query("dropped_examples", f"""WITH {PAPERS_SQL}, r AS (SELECT year, submission_id, CASE WHEN decision = 'Withdrawn' THEN 'withdrawn' WHEN n_chars <= 400 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS reason FROM papers)
SELECT year, submission_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY submission_id) AS rn FROM r WHERE reason IS NOT NULL) WHERE rn <= 5""")
def dropped_examples(load):
    """A18."""
    reason = F.when(F.col("decision") == "Withdrawn", "withdrawn").when(F.col("n_chars") <= 400, "short").when(F.col("lang") != "en", "language")
    return S.dropped_examples(papers(load), "year", "submission_id", reason, 5)


@query("distinct_decisions", f"WITH {PAPERS_SQL} SELECT year, string_agg(DISTINCT decision, ',' ORDER BY decision) AS decisions, count(DISTINCT decision) AS n FROM papers GROUP BY year")
def distinct_decisions(load):
    """A14, A15."""
    return S.distinct_values(papers(load), "year", "decision").select("year", F.array_join("values", ",").alias("decisions"), "n")


@query("first_labels", "SELECT source AS key, arg_min(lang, doc_id) AS label, min(doc_id) AS first_index FROM documents GROUP BY source")
def first_labels(load):
    """A8."""
    return S.first_label(load("documents").withColumnRenamed("source", "key"), "key", "lang", "doc_id")


@query("parse_success_rate", "SELECT role, round(avg(CASE WHEN contains(text, '.') THEN 100.0::DOUBLE ELSE 0 END), 6) AS rate FROM conversations GROUP BY role")
def parse_success_rate(load):
    """A16."""
    return S.success_rate(load("conversations"), "role", F.contains("text", F.lit("."))).withColumn("rate", F.round("rate", 6))


@query(
    "validation_stats",
    f"""WITH {PAPERS_SQL}, v AS (SELECT *, coalesce(regexp_matches(text, '^[A-Z]'), false) AS a, row_number() OVER (PARTITION BY year, coalesce(regexp_matches(text, '^[A-Z]'), false) ORDER BY submission_id) AS rn FROM papers)
SELECT year, count(*) AS total, count_if(a) AS with_abstract, count_if(contains(lower(text), 'intr')) AS with_intro, string_agg(submission_id::VARCHAR, ',' ORDER BY submission_id) FILTER (NOT a AND rn <= 5) AS missing FROM v GROUP BY year""",
)
def validation_stats(load):
    """A13."""
    found = S.validation_counts(papers(load), "year", "submission_id", {"with_abstract": F.col("text").rlike("^[A-Z]"), "with_intro": F.contains(F.lower("text"), F.lit("intr"))}, 5)
    return found.withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))
