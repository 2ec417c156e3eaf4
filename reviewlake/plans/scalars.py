"""Queries of the scalar functions: decisions, scores, text, answers, JSON, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import decisions as D
from reviewlake.functions import markdown as M
from reviewlake.functions import text as X
from reviewlake.plans.registry import query

_WORDS = ["Accept (Oral)", "notable-top-5%", "Invite to Talk", "Accept: notable-top-25%", "Accept (Spotlight)", "Accept (Poster)", "Accept", "Desk Reject", "Reject", "Withdrawn", "Pending", ""]
_VENUES = ["ICLR 2023 notable top 5%", "ICLR 2023 notable top 25%", "ICLR 2024 poster", "ICLR 2024 oral", "ICLR 2022 Spotlight", "Desk Rejected", "Rejected Submission", "Withdrawn Submission", "Submitted"]


def _pick(words: list[str], key: str = "doc_id"):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(key) % len(words) + 1).cast("int"))


def _pick_sql(words: list[str], key: str = "doc_id") -> str:
    return f"[{', '.join(repr(w) for w in words)}][({key} % {len(words)} + 1)::INTEGER]"


_CASE = """CASE WHEN {v} LIKE '%oral%' OR {v} LIKE '%talk%' OR contains({v}, 'notable-top-5%') THEN 'Accept (Oral)' WHEN {v} LIKE '%spotlight%' OR contains({v}, 'notable-top-25%') THEN 'Accept (Spotlight)'
 WHEN {v} LIKE '%poster%' OR ({v} LIKE '%accept%' AND {v} NOT LIKE '%reject%') THEN 'Accept (Poster)' WHEN {v} LIKE '%desk%' AND {v} LIKE '%reject%' THEN 'Desk Reject' WHEN {v} LIKE '%reject%' THEN 'Reject' WHEN {v} LIKE '%withdraw%' THEN 'Withdrawn' ELSE 'Unknown' END"""


@query("decision_normalised", f"WITH w AS (SELECT doc_id, lower({_pick_sql(_WORDS)}) AS v FROM documents) SELECT doc_id, {_CASE.format(v='v')} AS decision FROM w")
def decision_normalised(load):
    """N1."""
    return load("documents").select("doc_id", D.normalize_decision(_pick(_WORDS)).alias("decision"))


@query(
    "venue_decision",
    f"""WITH w AS (SELECT doc_id, lower({_pick_sql(_VENUES)}) AS v FROM documents) SELECT doc_id, CASE WHEN v LIKE '%oral%' OR contains(v, 'notable top 5%') THEN 'Accept (Oral)' WHEN v LIKE '%spotlight%' OR contains(v, 'notable top 25%') THEN 'Accept (Spotlight)'
 WHEN v LIKE '%poster%' THEN 'Accept (Poster)' WHEN v LIKE '%desk reject%' THEN 'Desk Reject' WHEN v LIKE '%reject%' THEN 'Reject' WHEN v LIKE '%withdraw%' THEN 'Withdrawn' ELSE 'Unknown' END AS decision FROM w""",
)
def venue_decision(load):
    """N2."""
    return load("documents").select("doc_id", D.venue_decision(_pick(_VENUES)).alias("decision"))


@query(
    "coarse_decision",
    f"""WITH w AS (SELECT doc_id, lower({_pick_sql(_WORDS)}) AS v FROM documents) SELECT doc_id, CASE WHEN contains(v, 'withdraw') THEN 'Withdrawn' WHEN contains(v, 'reject') THEN 'Reject' WHEN regexp_matches(v, 'accept|poster|spotlight|oral') THEN 'Accept' ELSE 'Unknown' END AS coarse,
  CASE WHEN contains(v, 'accept') THEN 'Accept' WHEN contains(v, 'reject') THEN 'Reject' ELSE 'Undecided' END AS class FROM w""",
)
def coarse_decision(load):
    """N4, N5."""
    return load("documents").select("doc_id", D.coarse_decision(_pick(_WORDS)).alias("coarse"), D.classify_decision(_pick(_WORDS)).alias("class"))


@query("score_prefix", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE (doc_id % 11)::INTEGER END AS score, CASE WHEN doc_id % 4 < 3 AND doc_id % 11 BETWEEN 1 AND 10 THEN (doc_id % 11)::INTEGER END AS bounded FROM documents")
def score_prefix(load):
    """N6, X4."""
    from reviewlake.operators.notes import bounded_score

    text = F.when(F.col("doc_id") % 4 == 3, "n/a").otherwise(F.concat(F.lit(" "), (F.col("doc_id") % 11).cast("string"), F.lit(": marginal")))
    return load("documents").select("doc_id", D.score_prefix(text).alias("score"), bounded_score(text, 1, 10).alias("bounded"))


@query("title_key", "SELECT p_partkey, regexp_replace(lower(coalesce(p_name, 'None')), '[^a-z0-9]', '', 'g') AS key FROM part")
def title_key(load):
    """T1."""
    return load("part").select("p_partkey", X.title_key(F.col("p_name")).alias("key"))


@query("header_clean", "SELECT doc_id, trim(translate(text, chr(10) || chr(9) || chr(13) || '*<', '   ')) AS header FROM documents")
def header_clean(load):
    """T5."""
    raw = F.concat(F.lit(" ** <span id='p'></span>"), F.translate("text", "\n\t\r<", "   "), F.lit("** <SPAN x>y</span>"))
    return load("documents").select("doc_id", X.clean_header(raw).alias("header"))


@query("whitespace_norm", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '.  ' || chr(10) || chr(10) || chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def whitespace_norm(load):
    """T15."""
    return load("documents").select("doc_id", X.normalize_whitespace(F.replace(F.col("text"), F.lit("."), F.lit(".  \n\n\n"))).alias("text"))


@query("abstract_anonymised", r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'Code is at https://github.com/a/b. ' ELSE '' END || text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: NOT contains(lower(x), 'https://github')) AS ss FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(ss, ' '), '\s+', ' ', 'g')) AS abstract FROM s""")
def abstract_anonymised(load):
    """T20."""
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "Code is at https://github.com/a/b. ").otherwise(""), F.col("text"))
    return load("documents").select("doc_id", X.anonymize_abstract(text).alias("abstract"))


@query("abstract_no_git", r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN '. See https: //x.git for all. Nothing more.' ELSE '' END, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(lower(x), '(?s)https:\s*//.*git')) AS ss FROM documents)
SELECT doc_id, regexp_replace(array_to_string(ss, ' '), '^\s+|\s+$', '', 'g') AS abstract FROM s""")
def abstract_no_git(load):
    """T21, T14."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, ". See https: //x.git for all. Nothing more.").otherwise(""))
    return load("documents").select("doc_id", X.remove_git_sentences(text).alias("abstract"))


@query("github_mentions", "SELECT page_id, contains(lower(h), 'github.com/') AS link, contains(lower(h), 'github') AS word FROM (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<a href=\"https://GitHub.com/x\">' WHEN 1 THEN ' on GITHUB.' ELSE '' END AS h FROM pages)")
def github_mentions(load):
    """F11, the first two forms, over whole pages."""
    html = F.concat("html", F.element_at(F.array(F.lit('<a href="https://GitHub.com/x">'), F.lit(" on GITHUB."), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))
    return load("pages").select("page_id", X.mentions_github_link(html).alias("link"), X.mentions_github(html).alias("word"))


@query("github_in_abstracts", "SELECT doc_id, doc_id % 3 = 0 OR contains(lower(text), 'github') AS in_abstract, doc_id % 3 < 2 OR contains(lower(text), 'github') AS anywhere FROM documents")
def github_in_abstracts(load):
    """F11, the third form: within the abstract of a markdown text that holds the whole document, and beyond it."""
    said = lambda k: F.when(F.col("doc_id") % 3 == k, "See GitHub.\n").otherwise("")
    md = F.concat(F.lit("# T\n\n## Abstract\n"), said(0), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n\n# 1 Introduction\n"), said(1))
    return load("documents").select("doc_id", X.mentions_github(F.coalesce(M.md_abstract(md), F.lit(""))).alias("in_abstract"), X.mentions_github(md).alias("anywhere"))


@query("truncated_paper", "SELECT doc_id, CASE WHEN length(text) > 353 THEN left(text, 353) || chr(10) || chr(10) || '[... truncated for length ...]' ELSE text END AS text FROM documents")
def truncated_paper(load):
    """T27."""
    return load("documents").select("doc_id", X.truncate(F.col("text"), 100).alias("text"))


@query("reviewer_ids", "SELECT conv_id, turn, 'Reviewer_' || turn::VARCHAR AS reviewer FROM conversations")
def reviewer_ids(load):
    """T28."""
    signature = F.concat(F.lit("ICLR/2024/Submission"), F.col("conv_id").cast("string"), F.lit("/Reviewer_"), F.col("turn").cast("string"))
    return load("conversations").select("conv_id", "turn", X.reviewer_id(signature).alias("reviewer"))


@query("pdf_hash", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN md5(url) ELSE '' END AS pdf_hash FROM pages")
def pdf_hash(load):
    """P13, T29."""
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/pdf/").otherwise("/attachment/"), F.md5("url"), F.lit(".pdf"))
    return load("pages").select("page_id", X.pdf_hash(path).alias("pdf_hash"))


@query("page_stems", r"SELECT page_id, regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') AS stem FROM pages")
def page_stems(load):
    """S4, T29."""
    return load("pages").select("page_id", X.path_stem(F.col("url")).alias("stem"))


_ANSWERS = ["Accept", "I would reject it", "accept, not reject", "7.5", "11", "85", "0.85", "3, 4 and 12", "nothing", "Poster"]


def _completion():
    return F.concat(F.lit("Reasoning: because of "), F.col("text"), F.lit("\nAnswer: "), _pick(_ANSWERS))


_ANSWER_SQL = f"SELECT doc_id, 'because of ' || rtrim(text, ' ' || chr(10)) AS reasoning, {_pick_sql(_ANSWERS)} AS a FROM documents"


@query("answers_decision", f"WITH q AS ({_ANSWER_SQL}) SELECT doc_id, reasoning, CASE WHEN contains(lower(a), 'accept') THEN 'Accept' WHEN contains(lower(a), 'reject') THEN 'Reject' END AS decision FROM q")
def answers_decision(load):
    """T30, T31."""
    return load("documents").select("doc_id", X.reasoning(_completion()).alias("reasoning"), X.answer_decision(_completion()).alias("decision"))


@query("answers_choice", f"WITH q AS ({_ANSWER_SQL}) SELECT doc_id, CASE WHEN lower(a) = 'accept' THEN 'accept' WHEN lower(a) = 'poster' THEN 'Poster' WHEN contains(lower(a), 'accept') THEN 'accept' WHEN contains(lower(a), 'reject') THEN 'Reject' END AS choice FROM q")
def answers_choice(load):
    """T31, task 1."""
    return load("documents").select("doc_id", X.answer_choice(_completion(), F.array(F.lit("Poster"), F.lit("accept"), F.lit("Reject"))).alias("choice"))


@query(
    "answers_numbers",
    rf"""WITH q AS ({_ANSWER_SQL}), n AS (SELECT doc_id, a, TRY_CAST(regexp_extract(a, '(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS x, regexp_extract_all(a, '\d+') AS c FROM q)
SELECT doc_id, CASE WHEN x BETWEEN 1 AND 10 THEN x END AS rating, CASE WHEN x > 1 AND x / 100 <= 1 THEN x / 100 WHEN x <= 1 THEN x END AS ratio, TRY_CAST(c[1] AS BIGINT) AS c1, TRY_CAST(c[2] AS BIGINT) AS c2 FROM n""",
)
def answers_numbers(load):
    """T31, tasks 2, 3, 5, 6."""
    c = X.answer_counts(_completion(), 2)
    return load("documents").select("doc_id", X.answer_rating(_completion()).alias("rating"), X.answer_ratio(_completion()).alias("ratio"), F.get(c, 0).alias("c1"), F.get(c, 1).alias("c2"))


@query("outer_json", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE props END AS json FROM events")
def outer_json(load):
    """X1."""
    text = F.when(F.col("event_id") % 5 == 4, "no json } here").otherwise(F.concat(F.lit("Sure, here: "), F.col("props"), F.lit(" done.")))
    return load("events").select("event_id", X.outer_json(text).alias("json"))


@query("indicator_field", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS binary_decision FROM documents")
def indicator_field(load):
    """X6."""
    json = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "accept").otherwise("reject").alias("binary_decision"), F.lit(3).alias("citations")))
    return load("documents").select("doc_id", F.get_json_object(json, "$.binary_decision").alias("binary_decision"))


@query("epochs", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds, year(ts)::INTEGER AS y, CASE WHEN event_id % 7 > 0 THEN epoch_ms(ts) // 1000 + 5 - epoch_ms(ts) // 1000 END AS latency FROM events")
def epochs(load):
    """D1-D4."""
    at = F.col("ts").cast("timestamp")
    ts = D.from_millis(F.unix_millis(at))
    first = F.when(F.col("event_id") % 7 > 0, F.unix_timestamp(at))
    return load("events").select("event_id", D.epoch_seconds(ts).alias("seconds"), F.year(ts).alias("y"), D.latency(first, F.unix_timestamp(at) + 5).alias("latency"))


@query("paper_horizons", "SELECT doc_id, least(greatest(2026 - (2020 + doc_id % 7), 0), 6)::INTEGER AS n, CASE WHEN doc_id % 7 < 6 THEN 1 ELSE 0 END::INTEGER AS first FROM documents")
def paper_horizons(load):
    """N8."""
    h = D.horizons((F.lit(2026) - (2020 + F.col("doc_id") % 7)).cast("int"))
    return load("documents").select("doc_id", F.size(h).alias("n"), F.coalesce(F.get(h, 0), F.lit(0)).alias("first"))


@query("mean_scores", "SELECT l_orderkey, round(avg(l_quantity), 6) AS mean, round((avg(l_quantity) - 1) / 9, 6) AS quality, greatest(0.1, least(0.95, sum(l_quantity) / 100.0)) AS percentile FROM lineitem GROUP BY 1")
def mean_scores(load):
    """N10."""
    rows = load("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("s"), F.sum("l_quantity").alias("t"))
    m = D.mean_score(F.col("s"))
    return rows.select("l_orderkey", F.round(m, 6).alias("mean"), F.round(D.quality(m), 6).alias("quality"), D.citation_percentile(F.col("t")).cast("double").alias("percentile"))
