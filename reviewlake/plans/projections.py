"""Queries of submissions, reviews by year, prompts, dataset rows, predicates and output indices."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.functions.validation import form_faults as form_faults_of
from reviewlake.operators import assembly as A
from reviewlake.operators import attempts as T
from reviewlake.operators import generation as G
from reviewlake.operators import layout as Y
from reviewlake.operators import notes as N
from reviewlake.operators import prompts as P
from reviewlake.operators import reviews as R
from reviewlake.operators import statistics as ST
from reviewlake.operators import submissions as S
from reviewlake.plans.nested import _items
from reviewlake.plans.registry import query
from reviewlake.plans.scalars import _VENUES, _pick, _pick_sql
from reviewlake.session import scratch
from reviewlake.sources import files as IO
from reviewlake.sources import outputs as O


def _doc():
    return F.col("doc_id")


def _year():
    return (2020 + _doc() % 7).cast("int")


def _lit(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _sql_fill(template: str, **values: str) -> str:
    """fill() in SQL."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(_lit(p) if i % 2 == 0 else f"({values[p]})::VARCHAR" for i, p in enumerate(parts))


# --- submissions ----------------------------------------------------------------------------------------------------------


def _notes(load):
    """Documents in the role of notes without replies; even ones of the newer API."""
    wrap = lambda c: F.when(_doc() % 2 == 0, F.to_json(F.struct(c.alias("value")))).otherwise(c)
    tldr = F.map_from_arrays(F.array(_pick(["TLDR", "TL;DR", "one-sentence_summary"])), F.array(wrap(F.when(_doc() % 5 == 0, "").otherwise(F.col("lang")))))
    fixed = F.create_map(F.lit("title"), wrap(F.concat(F.lit("On "), F.col("source"))), F.lit("abstract"), wrap(F.col("text")), F.lit("venue"), wrap(_pick(_VENUES)), F.lit("pdf"), wrap(F.when(_doc() % 3 == 0, "").otherwise(F.concat(F.lit("/pdf/"), _doc().cast("string"), F.lit(".pdf")))))
    words = F.when(_doc() % 4 > 0, F.create_map(F.lit("keywords"), F.when(_doc() % 2 == 0, '{"value": ["a", "b"]}').otherwise('["a"]'))).otherwise(F.create_map().cast("map<string, string>"))
    replies = F.array().cast("array<struct<id: string, replyto: string, signatures: array<string>, invitation: string, invitations: array<string>, content: map<string, string>>>")
    return load("documents").select(_doc().cast("string").alias("id"), _doc().cast("string").alias("forum"), F.when(_doc() % 6 > 0, _doc()).alias("number"), _year().alias("year"), (_doc() * 1000).alias("cdate"), F.lit(None).cast("long").alias("mdate"), F.map_concat(fixed, tldr, words).alias("content"), replies.alias("replies"))


_VENUE_CASE = "CASE WHEN v LIKE '%oral%' OR contains(v, 'notable top 5%') THEN 'Accept (Oral)' WHEN v LIKE '%spotlight%' OR contains(v, 'notable top 25%') THEN 'Accept (Spotlight)' WHEN v LIKE '%poster%' THEN 'Accept (Poster)' WHEN v LIKE '%desk reject%' THEN 'Desk Reject' WHEN v LIKE '%reject%' THEN 'Reject' WHEN v LIKE '%withdraw%' THEN 'Withdrawn' ELSE 'Unknown' END"


@query(
    "submissions",
    f"""WITH d AS (SELECT *, lower({_pick_sql(_VENUES)}) AS v FROM documents), s AS (SELECT (2020 + page_id % 7)::INTEGER AS year, page_id::VARCHAR || '_x' AS stem FROM pages),
p AS (SELECT doc_id, min(stem) AS stem FROM d JOIN s ON s.year = 2020 + d.doc_id % 7 AND starts_with(s.stem, d.doc_id::VARCHAR) GROUP BY doc_id)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 6 > 0 THEN doc_id ELSE 0 END AS number, 'On ' || source AS title, text AS abstract, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS tldr,
  CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS n_keywords, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://site/pdf/' || doc_id || '.pdf' END AS pdf_url, {_VENUE_CASE} AS decision,
  CASE WHEN doc_id > 0 THEN doc_id END AS created, coalesce('/pdfs/' || p.stem || '.pdf', '') AS pdf_path FROM d LEFT JOIN p USING (doc_id)""",
)
def submissions(load):
    """P1, S3, S4."""
    stem = F.concat(F.col("page_id").cast("string"), F.lit("_x"))
    pdfs = load("pages").select((2020 + F.col("page_id") % 7).cast("int").alias("year"), stem.alias("stem"), F.concat(F.lit("/pdfs/"), stem, F.lit(".pdf")).alias("path"))
    rows = S.submission(_notes(load), "https://site", pdfs=pdfs)
    return rows.select("id", "number", "title", "abstract", "tldr", F.size("keywords").alias("n_keywords"), "pdf_url", "decision", F.unix_timestamp("creation_date").alias("created"), "pdf_path")


@query(
    "plain_submissions",
    """SELECT doc_id::VARCHAR AS id, text AS abstract, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/pdf/' || doc_id || '.pdf' END AS pdf_url, doc_id * 1000 AS created_date, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 > 0 THEN lang END AS tldr,
  CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'a' END END AS keywords FROM documents""",
)
def plain_submissions(load):
    """P2."""
    rows = S.plain_submission(_notes(load), F.lit("Reject"))
    return rows.select("id", "abstract", "pdf_url", "created_date", "tldr", F.array_join("keywords", ",").alias("keywords"))


# --- reviews --------------------------------------------------------------------------------------------------------------


def _threads(load):
    """Conversations in the role of reviewed notes: of four turns a review, the authors' comment on it, the reviewer's on that, and a decision or meta-review."""
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.when(turn % 4 == 0, "Official_Review").when(turn % 4 < 3, "Official_Comment").when(turn % 8 == 3, "Decision").otherwise("Meta_Review")
    who = F.when(turn % 4 == 1, F.lit("c/Authors")).otherwise(F.concat(F.lit("c/Reviewer_"), (turn - turn % 4).cast("string")))
    wrap = lambda c: F.when(conv % 2 == 0, F.to_json(F.struct(c.alias("value")))).otherwise(c)
    names = dict.fromkeys(f.key or f.name for form in (*R.REVIEW_FORMS.values(), *R.META_FORMS.values()) for f in form if f.kind in ("str", "int") and f.name not in ("title", "code_of_conduct"))
    score = {"rating": F.concat((turn % 13).cast("string"), F.lit(": fair")), "confidence": F.concat((1 + turn % 6).cast("string"), F.lit(": sure"))} | {k: F.lit("3 good") for k in ("soundness", "presentation", "contribution")}
    values = {k: score.get(k, F.col("text")) for k in names} | {"review": F.when(conv % 3 > 0, F.col("text")), "decision": F.when(conv % 5 > 0, "Accept (Oral)")}
    content = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.when(v.isNotNull(), wrap(v)))]), lambda k, v: v.isNotNull())
    reply = F.struct(turn.alias("pos"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat_ws("/", "conv_id", turn - 1).alias("replyto"), F.array(who).alias("signatures"), F.concat(F.lit("c/-/"), kind).alias("invitation"), F.array().cast("array<string>").alias("invitations"), content.alias("content"))
    rows = load("conversations").groupBy("conv_id").agg(F.collect_list(reply).alias("replies"))
    rows = rows.withColumn("replies", F.array_sort("replies", lambda a, b: (a["pos"] - b["pos"]).cast("int")))
    return rows.withColumn("year", (2020 + F.col("conv_id") % 7).cast("int"))


_THREADS_SQL = """t AS (SELECT *, 2020 + conv_id % 7 AS year, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
r AS (SELECT *, CASE WHEN year <= 2021 THEN conv_id % 3 > 0 WHEN year <= 2023 THEN true ELSE turn % 13 <= 10 AND turn % 6 < 5 END AS valid FROM t WHERE turn % 4 = 0)"""


@query(
    "reviews_parsed",
    f"""WITH {_THREADS_SQL} SELECT conv_id, count_if(valid) AS n_valid, coalesce(sum(CASE WHEN valid AND last > turn THEN 1 ELSE 0 END), 0)::BIGINT AS answered, coalesce(sum(CASE WHEN valid AND last > turn + 1 THEN 1 ELSE 0 END), 0)::BIGINT AS followed,
  arg_min(CASE WHEN year >= 2024 THEN (turn % 13)::VARCHAR WHEN year <= 2021 THEN (turn % 13) || ': fair' END, turn) FILTER (valid) AS first_rating, arg_min(text, turn) FILTER (valid AND year IN (2022, 2023)) AS first_summary FROM r GROUP BY conv_id""",
)
def reviews_parsed(load):
    """P4, P18, X4, J9."""
    rows = _threads(load).withColumn("r", R.note_reviews(F.col("replies"), F.col("year")))
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    total = lambda name: F.aggregate(F.transform("r", lambda x: field(x, name).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.get("r", 0)
    return rows.select("conv_id", F.size("r").cast("long").alias("n_valid"), total("number_of_author_responses").alias("answered"), total("number_of_reviewer_responses_to_author").alias("followed"), field(first, "rating").alias("first_rating"), field(first, "summary_of_the_paper").alias("first_summary"))


@query(
    "metas_parsed",
    """WITH t AS (SELECT *, 2020 + conv_id % 7 AS year FROM conversations), m AS (SELECT conv_id, any_value(year) AS year, min(turn) FILTER (turn % 8 = 3) AS d, min(turn) FILTER (turn % 8 = 7) AS m FROM t GROUP BY conv_id)
SELECT m.conv_id, CASE WHEN year <= 2023 AND d IS NOT NULL AND m.conv_id % 5 > 0 THEN 'Accept (Oral)' END AS decision, CASE WHEN year >= 2024 AND m IS NOT NULL THEN t.text END AS metareview, coalesce(year <= 2023 AND d IS NOT NULL AND m.conv_id % 5 = 0, false) AS error
FROM m LEFT JOIN conversations t ON t.conv_id = m.conv_id AND t.turn = m.m""",
)
def metas_parsed(load):
    """P4, P19."""
    found = R.note_meta(F.col("replies"), F.col("year"))
    return _threads(load).select("conv_id", F.get_json_object(found["json"], "$.decision").alias("decision"), F.get_json_object(found["json"], "$.metareview").alias("metareview"), found["error"].alias("error"))


# What the forms look like in prompts, written out.
_REVIEW_FIELDS = """- summary: str (required) - Main summary/points of the review
- strengths: str (required) - Paper strengths identified by reviewer
- weaknesses: str (required) - Paper weaknesses identified by reviewer
- questions: list of str (optional) - Questions for authors
- sources: list of Source (optional) - Papers/sources mentioned in the review
  Fields for Source:
    - ref: str (required) - Link or title of referenced paper
    - within: str (required) - Which field: 'summary', 'strengths', 'weaknesses', 'questions'
- technical_novelty_contribution: str or null (optional) - Technical novelty assessment (if mentioned)
- empirical_novelty_contribution: str or null (optional) - Empirical contribution assessment (if mentioned)
- presentation: str or null (optional) - Presentation quality assessment (if mentioned)"""
_REVIEW_EXAMPLE = """{
  "summary": "...",
  "strengths": "...",
  "weaknesses": "...",
  "questions": [
    "..."
  ],
  "sources": [
    {
      "ref": "...",
      "within": "..."
    }
  ],
  "technical_novelty_contribution": "...",
  "empirical_novelty_contribution": "...",
  "presentation": "..."
}"""
_META_EXAMPLE = """{
  "summary": "...",
  "strengths": "...",
  "weaknesses": "...",
  "why_not_higher": "...",
  "why_not_lower": "..."
}"""


@query("form_texts", f"SELECT doc_id, {_lit(_REVIEW_FIELDS)} || chr(10) || text AS fields, {_lit(_META_EXAMPLE)} || text AS example FROM documents")
def form_texts(load):
    """The forms as text, as prompts put them before a document."""
    fields, example = F.lit(R.form_text(R.UNIVERSAL_REVIEW)), F.lit(R.form_example(R.UNIVERSAL_META))
    return load("documents").select("doc_id", F.concat(fields, F.lit("\n"), "text").alias("fields"), F.concat(example, "text").alias("example"))


_FAULTY = {
    0: ('{"summary": @, "strengths": "s", "weaknesses": "w", "questions": ["q", @], "sources": [{"ref": @, "within": "summary"}], "more": 1}', []),
    1: ("x@", [("", "json_invalid")]),
    2: ('{"summary": @, "weaknesses": 5}', [("strengths", "missing"), ("weaknesses", "string_type")]),
    3: ('{"summary": "", "strengths": @, "weaknesses": "w", "questions": @, "sources": null}', [("questions", "list_type"), ("sources", "list_type")]),
    4: ('{"summary": @, "strengths": "s", "weaknesses": "w", "questions": [@, 5, null]}', [("questions[1]", "string_type"), ("questions[2]", "string_type")]),
    5: ('{"summary": @, "strengths": "s", "weaknesses": "w", "sources": [{"ref": @}, @, {"ref": true, "within": "w"}]}', [("sources[0].within", "missing"), ("sources[1]", "model_type"), ("sources[2].ref", "string_type")]),
    6: ("[@]", [("", "model_type")]),
    7: ('{"summary": null, "strengths": @, "weaknesses": "w", "presentation": false, "empirical_novelty_contribution": null}', [("summary", "string_type"), ("presentation", "string_type")]),
}


def _completions(load):
    """(doc_id, text, json): documents with a completion that holds the whole text, of eight kinds by id."""
    kind, value = _doc() % 8, R.json_value(F.col("text"))
    made = F.coalesce(*[F.when(kind == k, F.concat(*[x for i, part in enumerate(form.split("@")) for x in ([value] if i else []) + [F.lit(part)]])) for k, (form, _) in _FAULTY.items()])
    return load("documents").select("doc_id", "text", made.alias("json"))


@query("form_faults", f"SELECT doc_id, path, reason FROM documents, (VALUES {', '.join(f'({k}, {_lit(path)}, {_lit(reason)})' for k, (_, faults) in _FAULTY.items() for path, reason in faults)}) v(k, path, reason) WHERE doc_id % 8 = k")
def form_faults(load):
    """Every fault of completions held against the review form, with its place."""
    return _completions(load).select("doc_id", F.explode(form_faults_of(F.col("json"), R.UNIVERSAL_REVIEW)).alias("f")).select("doc_id", "f.path", "f.reason")


@query(
    "failed_rows",
    r"""WITH d AS (SELECT *, doc_id % 8 <> 0 AS faulty, regexp_matches(text, '[^\x00-\x7F]') AS wide FROM documents)
SELECT doc_id, CASE WHEN faulty THEN 'failed' WHEN wide THEN 'failed' ELSE 'good' END AS outcome, CASE WHEN faulty THEN 'form' WHEN wide THEN 'encode' END AS stage,
  CASE WHEN faulty THEN CASE doc_id % 8 WHEN 1 THEN 'json_invalid' WHEN 2 THEN 'missing' WHEN 3 THEN 'list_type' WHEN 6 THEN 'model_type' WHEN 5 THEN 'missing' ELSE 'string_type' END WHEN wide THEN 'UnicodeEncodeError' END AS error,
  CASE WHEN NOT faulty AND NOT wide THEN strlen(text) END AS n_bytes FROM d""",
)
def failed_rows(load):
    """A check and a function that raises for some texts, over whole texts; both outputs are written in one pass and read back."""
    rows = _completions(load).withColumn("faults", form_faults_of(F.col("json"), R.UNIVERSAL_REVIEW))
    rows = rows.withColumn("tried", T.attempt(lambda text: len(text.encode("ascii")), "long", F.col("text"), when=F.size("faults") == 0))
    both = T.with_outcome(rows.select("doc_id", "faults", "tried"), [("form", F.when(F.size("faults") > 0, F.get("faults", 0)["reason"])), ("encode", F.col("tried.error"))])
    path = scratch(both.sparkSession, "outcomes")
    T.write_both(both, path)
    read = lambda outcome: T.read_outcome(both.sparkSession, path, outcome, both).select("doc_id", F.lit(outcome).alias("outcome"), "stage", F.regexp_extract("error", r"^\w+", 0).alias("error"), F.col("tried.value").alias("n_bytes"))
    return read(T.GOOD).unionByName(read(T.FAILED))


# --- prompts --------------------------------------------------------------------------------------------------------------

_ORIGINAL = '{{\n  "rating": "6: fair",\n  "confidence": "3: sure",\n  "review": {review},\n  "title": {title},\n  "number_of_author_responses": 0,\n  "number_of_reviewer_responses_to_author": 0\n}}'.replace("{{", "{").replace("}}", "}")


@query(
    "normaliser_prompts",
    f"""WITH o AS (SELECT doc_id, {_sql_fill(_ORIGINAL, review="to_json(text)", title="CASE WHEN doc_id % 2 = 0 THEN to_json(source) ELSE '\"\"' END")} AS original FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS submission_id, 'review' AS type, 0 AS review_index, original AS original_json, {_sql_fill(P.NORMALISE, kind="'Review'", original="original", fields=_lit(_REVIEW_FIELDS), example=_lit(_REVIEW_EXAMPLE))} AS prompt FROM o""",
)
def normaliser_prompts(load):
    """P16, X5."""
    content = F.map_filter(F.create_map(F.lit("rating"), F.lit("6: fair"), F.lit("confidence"), F.lit("3: sure"), F.lit("review"), F.col("text"), F.lit("title"), F.when(_doc() % 2 == 0, F.col("source"))), lambda k, v: v.isNotNull())
    reply = F.struct(F.lit("r").alias("id"), F.lit("").alias("replyto"), F.array(F.lit("Reviewer_1")).alias("signatures"), F.lit("Official_Review").alias("invitation"), F.array().cast("array<string>").alias("invitations"), content.alias("content"))
    rows = load("documents").select(_doc().cast("string").alias("id"), F.lit(2021).alias("year"), F.lit(None).cast("string").alias("md_path"), F.array(reply).alias("replies"))
    return P.normaliser_prompts(rows).select("submission_id", "type", "review_index", "original_json", "prompt")


_EX = [("T1", "A1", "2021", "Accept (Oral)", "250", "[8, 6, null, 7]", True), ("T2", "A2", "2024", None, "12", "none", False), ("T3", "A3", "2023", "Reject", None, "[3, 3.5]", None), ("T4", "A4", "2022", "Reject", "1", "[]", True)]


def _sql_examples(rows: list[str]) -> str:
    return _lit(P.EXAMPLES + "".join(f"Example {i}:\n{r}\n\n" for i, r in enumerate(rows, 1)))


def _ex(answer: str, i: int, reasoning: str = "") -> str:
    middle = f"\n\nReasoning: {reasoning}" if reasoning else ""
    return f"Title: {_EX[i][0]}\n\nAbstract: {_EX[i][1]}{middle}\n\nAnswer: {answer}"


_IMPACT = "This paper addresses {} with {}. Expected {} citation impact."
_HIGH, _LOW = _IMPACT.format("a fundamental problem", "novel insights", "high"), _IMPACT.format("an interesting problem", "a reasonable approach", "moderate")
_QUALITY = "This paper presents {} work. Reviewers would likely {}. Expected confidence-weighted score reflects {}."
_STRONG, _SOLID = _QUALITY.format("strong", "agree on high quality", "strong accept"), _QUALITY.format("solid", "find it acceptable", "borderline accept")
_KNOWN = dict(title="source", abstract="text", year="2020 + doc_id % 7")
_TASKS = {
    1: f"CASE WHEN doc_id % 3 > 0 THEN {_sql_fill(P.TASK_1, examples=_sql_examples([_ex('Accept (Oral)', 0), _ex('Unknown', 1), _ex('Reject', 2), _ex('Reject', 3)]), decisions=_lit('- Accept' + chr(10) + '- ') + ' || lang', **_KNOWN)} ELSE 'No decisions available for this year' END",
    2: "CASE WHEN 2026 - (2020 + doc_id % 7) >= 1 THEN "
    + _sql_fill(P.TASK_2, examples=_sql_examples([_ex("250 citations at horizon 5", 0), _ex("12 citations at horizon 2", 1), _ex("10 citations at horizon 3", 2)]), published="2019 + doc_id % 7", count="6 - doc_id % 7", horizons="array_to_string(list_transform(range(1, 7 - doc_id % 7), lambda h: h || CASE WHEN h > 1 THEN ' years' ELSE ' year' END), ', ')", **_KNOWN)
    + " ELSE 'No valid horizons' END",
    3: _sql_fill(P.TASK_3, examples=_sql_examples([_ex("7.0", 0), _ex("7.0", 1), _ex("3.2", 2)]), **_KNOWN),
    5: _sql_fill(P.TASK_5, examples=_sql_examples([_ex("0.95", 0, _HIGH), _ex("0.12", 1, _LOW), _ex("0.10", 2, _LOW)]), **_KNOWN),
    6: _sql_fill(P.TASK_6, examples=_sql_examples([_ex("0.67", 0, _SOLID), _ex("0.65", 1, _SOLID), _ex("0.25", 2, _SOLID)]), **_KNOWN),
    7: "CASE WHEN doc_id % 2 = 0 THEN "
    + _sql_fill(P.TASK_7, source="'the full paper content'", examples="''", content="'Paper Content:' || chr(10) || CASE WHEN length(text) > 63600 THEN left(text, 63600) || chr(10) || chr(10) || '[... truncated for length ...]' ELSE text END", **_KNOWN)
    + " ELSE "
    + _sql_fill(P.TASK_7, source="'the paper''s title and abstract'", examples="''", content="'Abstract: ' || coalesce(text, '')", **_KNOWN)
    + " END",
}


@query("legacy_prompts", "SELECT doc_id, " + ", ".join(f"md5({sql}) AS task_{k}" for k, sql in _TASKS.items()) + " FROM documents")
def legacy_prompts(load):
    """P17, C10, N8."""
    kinds = ("title", "abstract", "year", "paper_decision", "gs_citation_copy", "extracted_scores", "Accepted")
    examples = F.array(*[F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("boolean" if k == "Accepted" else "string")).alias(k) for k, v in zip(kinds, e)]) for e in _EX])
    rows = load("documents").select("doc_id", _year().alias("year"), F.col("source").alias("title"), F.col("text").alias("abstract"), "lang")
    decisions = F.when(_doc() % 3 > 0, F.array(F.lit("Accept"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    paper = F.when(_doc() % 2 == 0, F.col("abstract"))
    return rows.select("doc_id", *[F.md5(P.prediction_prompt(k, None if k == 7 else examples, decisions, paper if k == 7 else None)).alias(f"task_{k}") for k in _TASKS])


@query(
    "normalised_rows",
    """SELECT conv_id, turn, turn % 3 < 2 AS parse_success, CASE WHEN turn % 3 < 2 THEN text END AS summary, CASE WHEN turn % 3 < 2 AND turn % 2 = 0 THEN 1 END AS n_questions, CASE WHEN turn % 4 > 0 THEN turn * 0.5::DOUBLE END AS time_taken_llm FROM conversations""",
)
def normalised_rows(load):
    """E2, X2, D4."""
    turn, text = F.col("turn"), F.col("text")
    form = F.struct(text.alias("summary"), F.lit("s").alias("strengths"), F.lit("w").alias("weaknesses"), F.array(F.lit("q")).alias("questions"))
    good = F.when(turn % 3 == 0, F.to_json(form)).when(turn % 3 == 1, F.concat(F.lit('So: {"properties": '), F.to_json(form), F.lit("}"))).otherwise("{}")
    metrics = F.struct(F.when(turn % 4 > 0, turn * 0.5).alias("arrival_time"), (turn * 1.0).cast("double").alias("last_token_ts"))
    rows = load("conversations").select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("submission_id"), F.lit(2024).alias("year"), F.lit(None).cast("string").alias("md_path"), F.when(turn % 2 == 0, "review").otherwise("meta").alias("type"), turn.alias("review_index"), F.lit("{}").alias("original_json"), F.lit("p").alias("prompt"),
        F.array(F.lit("nothing"), good).alias("completions"), F.lit(1).alias("num_generated_tokens"), metrics.alias("metrics"),
    )
    out = P.normalised_rows(rows)
    field = lambda name: F.get_json_object("normalized_json", f"$.{name}")
    return out.select(F.col("submission_id").cast("long").alias("conv_id"), F.col("review_index").alias("turn"), "parse_success", field("summary").alias("summary"), F.json_array_length(field("questions")).alias("n_questions"), "time_taken_llm")


@query(
    "predicted_rows",
    """SELECT conv_id AS original_index, CASE WHEN turn % 3 = 0 THEN 'Accept' WHEN turn % 3 = 1 THEN 'Reject' END AS answer, 'Since ' || turn AS reasoning, 7 AS indicator, turn * 0.25::DOUBLE AS time_taken_llm FROM conversations""",
)
def predicted_rows(load):
    """E3, T30, T31."""
    turn = F.col("turn")
    made = F.concat(F.lit("Reasoning: Since "), turn.cast("string"), F.lit("\nAnswer: "), F.when(turn % 3 == 0, "an ACCEPT").when(turn % 3 == 1, "Reject").otherwise("none"))
    metrics = F.struct(F.lit(0.0).alias("arrival_time"), (turn * 0.25).cast("double").alias("last_token_ts"))
    rows = load("conversations").select(made.alias("generated_text"), F.col("conv_id").alias("original_index"), F.col("text").alias("prompt"), F.lit(3).alias("num_generated_tokens"), metrics.alias("metrics"))
    return P.predicted_rows(rows, 7).select("original_index", "extracted_decision.answer", "extracted_decision.reasoning", "indicator", "time_taken_llm")


# --- dataset rows ---------------------------------------------------------------------------------------------------------


@query(
    "split_columns",
    """SELECT doc_id::VARCHAR AS submission_id, CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'test' ELSE '' END AS split, coalesce(l.label, '') AS deepreview_split, coalesce(l.i, -1) AS deepreview_row_index
FROM documents LEFT JOIN (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS label, item_id * 2 AS i FROM benchmark) l ON l.item_id = doc_id""",
)
def split_columns(load):
    """P9, A8."""
    key = _doc().cast("string").alias("submission_id")
    splits = load("documents").filter("doc_id % 3 < 2").select(key, F.when(_doc() % 3 == 0, "train").otherwise("test").alias("split"))
    item = F.col("item_id")
    twice = load("benchmark").select(item.cast("string").alias("submission_id"), F.when(item % 2 == 0, "a").otherwise("b").alias("label"), (item * 2).alias("i"))
    marked = ST.first_label(twice.unionByName(twice.withColumn("i", F.col("i") + 7)), "submission_id", "label", "i")
    return S.with_split(load("documents").select(key), splits, marked)


@query(
    "enriched_rows",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS original_md_content, CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END AS clean_md_content, CASE WHEN doc_id % 5 = 4 OR doc_id % 3 > 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN 'b,a' ELSE 'b' END END AS images,
  CASE WHEN doc_id % 3 > 0 THEN 0 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS pages FROM documents""",
)
def enriched_rows(load):
    """P10, S20, S21."""
    d, name = load("documents"), _doc().cast("string")
    texts = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("/o/"), name).alias("path"), F.col("text").alias("value")).unionByName(d.filter("doc_id % 4 = 0").select(F.concat(F.lit("/c/"), name).alias("path"), F.col("text").alias("value")))
    png, text = F.unhex(F.lit("89504E470D0A1A0A00")), F.lit("no image").cast("binary")
    images = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("/i/"), name, F.lit("/b")).alias("path"), png.alias("content")).unionByName(d.filter("doc_id % 3 = 0").select(F.concat(F.lit("/i/"), name, F.lit("/a")).alias("path"), F.when(_doc() % 2 == 0, png).otherwise(text).alias("content")))
    at = lambda x: F.concat(F.lit("/i/"), name, F.lit(x))
    listed = F.when(_doc() % 5 == 4, "{broken").otherwise(F.to_json(F.create_map(F.lit("b"), at("/b"), F.lit("a"), at("/a"), F.lit("c"), F.lit("/none"))))
    rows = d.select("doc_id", F.concat(F.lit("/o/"), name).alias("original_md_path"), F.concat(F.lit("/c/"), name).alias("clean_md_path"), listed.alias("images_in_clean_md"), F.to_json(F.array(at("/a"), at("/none"), at("/b"))).alias("clean_pdf_img_paths"))
    got = S.enriched(rows, texts, images, "doc_id")
    return got.select("doc_id", "original_md_content", "clean_md_content", F.array_join(F.transform("md_images", lambda x: x["name"]), ",").alias("images"), F.size("pdf_page_images").alias("pages"))


@query("canonical_rows", "SELECT doc_id::VARCHAR AS submission_id, (2020 + doc_id % 7)::BIGINT AS year, text AS title, lang AS _pdf_path, 22 AS n_columns FROM documents")
def canonical_rows(load):
    """P15."""
    names = [f.name for f in S.CANONICAL]
    given = {"submission_id": _doc().cast("string"), "year": _year(), "title": F.col("text"), "_pdf_path": F.col("lang")}
    rows = load("documents").select(F.lit("extra").alias("extra"), *[given.get(n, F.lit("")).alias(n) for n in reversed(names)])
    out = S.canonical(rows)
    return out.select("submission_id", "year", "title", "_pdf_path", F.lit(len(out.columns)).alias("n_columns"))


@query(
    "paper_rows",
    """SELECT doc_id::VARCHAR AS id, 'On ' || source AS title, '# INTRODUCTION' || chr(10) || chr(10) || 'Some words.' || chr(10) || chr(10) || '# REFERENCES' || chr(10) || chr(10) || '[' || doc_id || '] One.' AS clean_md, 2 AS n_sections, CASE WHEN doc_id % 2 = 0 THEN '/pdf/' || doc_id END AS pdf_path,
  CASE WHEN doc_id > 0 THEN doc_id END AS created FROM documents WHERE doc_id % 4 > 0""",
)
def paper_rows(load):
    """P6, P5, T8, T17."""
    notes, name = _notes(load), F.col("id")
    head = F.when(F.col("id").cast("long") % 4 > 0, "# Abstract\n\nShort.\n\n").otherwise("# Preface\n\n")
    markdown = notes.select("id", F.concat(F.lit("/md/"), name).alias("path"), F.concat(head, F.lit("# Introduction\n\nSome words.\n\n# References\n\n["), name, F.lit("] One.\n")).alias("value"))
    pdfs = notes.filter("cast(id as long) % 2 = 0").select("id", F.concat(F.lit("/pdf/"), name).alias("path"))
    rows = S.paper_rows(notes, S.submission(notes), markdown, pdfs)
    field = lambda name: F.get_json_object("submission", f"$.{name}")
    return rows.select(field("id").alias("id"), field("title").alias("title"), "clean_md", F.size("clean_md_sections").alias("n_sections"), "pdf_path", field("created_date").cast("long").alias("created"))


# --- predicates -----------------------------------------------------------------------------------------------------------


@query(
    "paper_flags",
    """WITH f AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'Withdrawn' ELSE 'Reject' END AS decision FROM documents)
SELECT doc_id, doc_id % 5 > 0 AND doc_id % 2 = 0 AND doc_id % 3 > 0 AS complete, doc_id % 5 > 0 AND doc_id % 7 > 0 AND doc_id % 2 = 0 AND doc_id % 4 < 3 AS candidate, doc_id % 3 > 0 AND doc_id % 2 = 0 AS reviews, doc_id % 2 = 0 AND doc_id % 3 > 0 AS whole,
  doc_id % 11 > 0 AND doc_id % 2 = 0 AND doc_id % 3 > 0 AS paper, decision <> 'Withdrawn' AND (doc_id % 3 > 0 OR doc_id % 7 = 6) AS kept FROM f""",
)
def paper_flags(load):
    """F1-F6, F8, F13."""
    from reviewlake.functions import decisions as D

    decision = F.when(_doc() % 5 == 0, "Withdrawn").otherwise("Reject")
    md = F.concat(F.when(_doc() % 2 == 0, "# Abstract\n").otherwise(""), F.replace(F.col("text"), F.lit("#"), F.lit("")), F.when(_doc() % 3 > 0, "\n**References**\n").otherwise(""))
    meta = F.when(_doc() % 7 > 0, F.struct((_doc() % 2 == 0).alias("has_abstract"), F.lit(4).alias("page_end")))
    count = F.when(_doc() % 4 < 3, 5).otherwise(4)
    reviews, note = F.when(_doc() % 3 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(_doc() % 2 == 0, 1)
    rows = load("documents").withColumns({"a": note, "b": F.when(_doc() % 3 > 0, 1), "c": F.lit(1)})
    known = F.when(_doc() % 5 == 0, "Withdrawn").when(_doc() % 3 == 0, "Unknown").otherwise("Accept")
    return rows.select(
        "doc_id", S.complete_paper(decision, md).alias("complete"), S.dataset_candidate(meta, count, decision).alias("candidate"), S.valid_reviews(reviews, note).alias("reviews"), S.complete_submission("a", "b", "c").alias("whole"), N.valid_paper((_doc() % 11).cast("int"), _doc() % 2 == 0, _doc() % 3 > 0).alias("paper"), D.keep_in_manifest(known, _year()).alias("kept")
    )


@query(
    "chosen_rows",
    """WITH d AS (SELECT *, 2020 + doc_id % 7 AS year, CASE WHEN doc_id % 3 > 0 THEN lang END AS md_path FROM documents), i AS (SELECT page_id::VARCHAR AS id, page_id % 4 AS n FROM pages), r AS (SELECT doc_id, d.year, md_path, d.doc_id::VARCHAR IN (SELECT id FROM i) AS known, d.doc_id::VARCHAR IN (SELECT id FROM i WHERE n > 0) AS shown FROM d)
SELECT 'any' AS rule, count_if(known) AS n FROM r UNION ALL SELECT 'images', count_if(shown) FROM r UNION ALL SELECT 'task 7 papers', count_if(md_path IS NOT NULL AND year < 2026) FROM r UNION ALL SELECT 'task 3', count(*) FROM r UNION ALL SELECT 'found', count_if(doc_id % 2 = 0) FROM r""",
)
def chosen_rows(load):
    """F7, F9, F10."""
    rows = load("documents").select(_doc().cast("string").alias("submission_id"), _year().alias("year"), F.when(_doc() % 3 > 0, F.col("lang")).alias("md_path"), F.when(_doc() % 2 == 0, "Found").otherwise("Missing").alias("status"))
    index = load("pages").select(F.col("page_id").cast("string").alias("submission_id"), (F.col("page_id") % 4).alias("image_count"))
    parts = {"any": S.with_prompts(rows, index, False), "images": S.with_prompts(rows, index, True), "task 7 papers": S.task_rows(rows, 7, True), "task 3": S.task_rows(rows, 3), "found": S.found_versions(rows)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "manifest_counters",
    """WITH m AS (SELECT (2020 + doc_id % 7)::INTEGER AS year, CASE WHEN doc_id % 5 = 0 THEN 'Withdrawn' WHEN doc_id % 3 = 0 THEN 'Unknown' WHEN doc_id % 2 = 0 THEN 'Accept' ELSE 'Reject' END AS decision, CASE WHEN doc_id % 4 = 0 THEN 'revision' WHEN doc_id % 4 = 1 THEN 'note' END AS source FROM documents),
c AS (SELECT year, unnest(CASE WHEN decision = 'Withdrawn' THEN ['skipped_withdrawn'] WHEN decision = 'Unknown' AND year <> 2026 THEN ['skipped_unknown'] ELSE [decision, 'source_' || coalesce(source, 'None')] END) AS counter FROM m)
SELECT year, counter, count(*) AS n FROM c GROUP BY ALL""",
)
def manifest_counters(load):
    """A12, F8."""
    decision = F.when(_doc() % 5 == 0, "Withdrawn").when(_doc() % 3 == 0, "Unknown").when(_doc() % 2 == 0, "Accept").otherwise("Reject")
    return S.manifest_counters(load("documents").select(_year().alias("year"), decision.alias("decision"), F.when(_doc() % 4 == 0, "revision").when(_doc() % 4 == 1, "note").alias("pdf_source")))


@query("sorted_entries", "SELECT doc_id, 'lang=' || lang || ',source=' || source || ',text=' || text AS entries, '- ' || lang || chr(10) || '- ' || source AS bullets FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def sorted_entries(load):
    """C9, C10."""
    d = load("documents").filter("text is not null and lang is not null and source is not null")
    held = F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return d.select("doc_id", F.array_join(F.transform(S.sorted_entries(held), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"), S.bullet_list(F.array("lang", "source")).alias("bullets"))


# --- files ----------------------------------------------------------------------------------------------------------------


@query(
    "normalized_index",
    """SELECT doc_id::VARCHAR AS submission_id, doc_id % 2 = 0 AS pdf, doc_id % 4 AS image_count, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS has_abstract, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 ELSE 0 END END::INTEGER AS page_end,
  CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN '' END AS abstract FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 > 0 OR doc_id % 3 > 0""",
)
def normalized_index(load):
    """S7."""
    d, sid = load("documents"), _doc().cast("string")
    top = F.concat(F.lit("/n/2024/"), sid, F.lit("/"))
    images = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= _doc() % 4, F.concat(top, F.lit("redacted_pdf_img_content/page_"), i.cast("string"), F.lit(".png"))))
    paths = F.array_compact(F.concat(images, F.array(F.when(_doc() % 2 == 0, F.concat(top, sid, F.lit(".pdf"))), F.when(_doc() % 3 > 0, F.concat(top, sid, F.lit("_meta.json"))))))
    value = F.when(_doc() % 5 == 0, "{broken").when(_doc() % 2 == 0, F.to_json(F.struct(F.lit(True).alias("has_abstract"), (_doc() % 9).alias("page_end")))).otherwise("{}")
    found = O.normalized_index(d.select(F.explode(paths).alias("path")), d.select(F.concat(top, sid, F.lit("_meta.json")).alias("path"), value.alias("value")))
    return found.select("submission_id", "pdf", "image_count", F.col("meta.has_abstract").alias("has_abstract"), F.col("meta.page_end").alias("page_end"), F.col("meta.anonymized_abstract").alias("abstract"))


@query(
    "batch_files",
    """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 12, '0')) - 1 AS i FROM orders)
SELECT '/p/' || lpad(o_orderkey::VARCHAR, 12, '0') || '.pdf' AS path, 'batch_' || lpad((i // 2200)::VARCHAR, greatest(2, length((i // 2200)::VARCHAR))::INTEGER, '0') AS batch, 'batch_' || lpad((i // 2200)::VARCHAR, greatest(2, length((i // 2200)::VARCHAR))::INTEGER, '0') || '/' || lpad(o_orderkey::VARCHAR, 12, '0') || '.pdf' AS link FROM i""",
)
def batch_files(load):
    """S22, W8, W9."""
    return O.batch_assignment(load("orders").select(F.concat(F.lit("/p/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".pdf")).alias("path")))


@query(
    "merged_outputs",
    """WITH o AS (SELECT page_id % 700 AS s, min('batch_' || page_id % 9) AS batch FROM pages GROUP BY 1) SELECT 's' || s AS stem, batch, (2020 + s % 7)::INTEGER AS year FROM o WHERE s IN (SELECT doc_id FROM documents) AND s % 4 > 0""",
)
def merged_outputs(load):
    """S22."""
    page, name = F.col("page_id"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    outputs = load("pages").select(name(page % 700).alias("stem"), F.concat(F.lit("batch_"), (page % 9).cast("string")).alias("batch"))
    pdfs = load("documents").select(name(_doc()).alias("stem"), _year().alias("year"))
    return O.merged_outputs(outputs, pdfs, pdfs.filter("cast(substr(stem, 2) as long) % 4 = 0"))


@query("pdf_copies", "SELECT '/a/' || doc_id || '.pdf' AS old_path, '/b/' || doc_id || '_.pdf' AS new_path FROM documents WHERE doc_id % 3 > 0")
def pdf_copies(load):
    """S27."""
    name = _doc().cast("string")
    files = load("documents").select(F.explode(F.array(F.concat(F.lit("/a/"), name, F.lit(".pdf")), F.concat(F.lit("/a/"), name, F.lit(".txt")))).alias("path"))
    return O.pdf_copies(files, load("documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("/b/"), name, F.lit("_.pdf")).alias("path")), "/b")


@query(
    "file_indices",
    """SELECT doc_id::VARCHAR AS id, (2020 + doc_id % 7)::INTEGER AS year, CASE WHEN doc_id % 3 > 0 THEN '/m/' || (2020 + doc_id % 7) || '/' || doc_id || '/' || doc_id || '.md' END AS md_path, CASE WHEN doc_id % 4 > 0 THEN 'batch_' || (doc_id % 4) END AS batch, coalesce(nullif(doc_id % 5, 0), NULL)::BIGINT AS images FROM documents""",
)
def file_indices(load):
    """S5-S7, S29."""
    d, name, year = load("documents"), _doc().cast("string"), _year().cast("string")
    join = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    md = d.filter("doc_id % 3 > 0").select(join("/m", year, name, F.concat(name, F.lit(".md"))).alias("path")).unionByName(d.select(join("/m", year, name, F.lit("other.md")).alias("path")))
    batches = d.filter("doc_id % 4 > 0").select(F.explode(F.sequence(F.lit(1), (_doc() % 4).cast("int"))).alias("b"), name.alias("n")).select(F.concat(F.lit("/l/batch_"), F.col("b").cast("string"), F.lit("/"), F.col("n"), F.lit("/x.json")).alias("path"), F.lit(99).alias("length"))
    empty = d.select(F.concat(F.lit("/l/batch_9/"), name, F.lit("/x.json")).alias("path"), F.lit(10).alias("length"))
    pages = d.filter("doc_id % 5 > 0").select(F.explode(F.sequence(F.lit(1), (_doc() % 5).cast("int"))).alias("p"), name.alias("n")).select(F.concat(F.lit("/i/"), F.col("n"), F.lit("/page_"), F.col("p").cast("string"), F.lit(".png")).alias("path"))
    rows = A.with_markdown_path(d.select(name.alias("id"), _year().alias("year")), md)
    layouts, images = IO.layout_index(batches.unionByName(empty)).select(F.col("stem").alias("id"), "batch"), IO.image_counts(pages).select(F.col("submission_id").alias("id"), F.col("image_count").alias("images"))
    stems = IO.markdown_index(md).select(F.col("stem").alias("id"), F.lit(True).alias("held"))
    checked = rows.join(stems, "id", "left").withColumn("md_path", F.when(F.col("held"), F.col("md_path")))
    return checked.join(layouts, "id", "left").join(images, "id", "left").select("id", "year", "md_path", "batch", "images")


@query(
    "folders_and_backups",
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 > 0 THEN 2021 WHEN doc_id % 3 > 0 THEN 2022 END AS folder_year, CASE WHEN doc_id % 5 > 0 THEN '/p/old/' || doc_id || '_v' || doc_id || '.pdf' END AS backup FROM documents""",
)
def folders_and_backups(load):
    """S30, S31."""
    d, name = load("documents"), _doc().cast("string")
    folder = lambda y, keep: d.filter(keep).select(F.lit(y).alias("year"), name.alias("id"), F.concat(F.lit(f"/n/{y}/"), name).alias("path"))
    rows = A.submission_folders(d.select(name.alias("id")), folder(2022, "doc_id % 3 > 0").unionByName(folder(2021, "doc_id % 4 > 0")))
    changed = d.select(name.alias("submission_id"), F.when(_doc() % 5 > 0, F.concat(F.lit("v"), name)).otherwise("").alias("old_download_id"))
    files = d.select(F.concat(F.lit("/p/2020/"), name, F.lit("_v"), name, F.lit(".pdf")).alias("path"))
    moved = A.pdf_backups(changed, files, 2020, "old").select(F.regexp_extract("old_path", r"/(\d+)_v\d+\.pdf$", 1).alias("id"), F.col("new_path").alias("backup"))
    return rows.join(moved, "id", "left").select("id", "folder_year", "backup")


@query(
    "dataset_card",
    """WITH r AS (SELECT (2020 + doc_id % 3)::INTEGER AS year, count(*) AS reviewable, count_if(doc_id % 2 = 0) AS reject, count_if(doc_id % 4 = 1) AS poster, count_if(doc_id % 8 = 3) AS spotlight, count_if(doc_id % 8 = 7) AS oral, count_if(doc_id % 5 = 0 AND doc_id % 3 < 2) AS complete FROM documents GROUP BY 1),
s AS (SELECT year, sum(reviewable)::BIGINT AS a, sum(complete)::BIGINT AS b, sum(reject)::BIGINT AS c, sum(poster)::BIGINT AS d, sum(spotlight)::BIGINT AS e, sum(oral)::BIGINT AS f FROM r GROUP BY ROLLUP (year)),
t AS (SELECT *, [coalesce(year::VARCHAR, 'Total'), format('{:,}', a), format('{:,}', b), CASE WHEN a > 0 THEN round_even(100.0::DOUBLE * b / a, 1)::VARCHAR ELSE '0' END || '%', format('{:,}', c), format('{:,}', d), format('{:,}', e), format('{:,}', f)] AS cells FROM s)
SELECT year, '| ' || array_to_string(CASE WHEN year IS NULL THEN list_transform(cells, lambda x: '**' || x || '**') ELSE cells END, ' | ') || ' |' AS line FROM t""",
)
def dataset_card(load):
    """S26, A6."""
    year = (2020 + _doc() % 3).cast("int").alias("year")
    d = load("documents")
    count = lambda c: F.count_if(c)
    coverage = d.groupBy(year).agg(F.count("*").alias("reviewable"), count(_doc() % 2 == 0).alias("reject"), count(_doc() % 4 == 1).alias("poster"), count(_doc() % 8 == 3).alias("spotlight"), count(_doc() % 8 == 7).alias("oral"))
    complete = d.filter("doc_id % 5 = 0 and doc_id % 3 < 2").groupBy(year).agg(F.count("*").alias("n"))
    return O.card_rows(coverage, complete)


@query(
    "normalised_papers",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Empty content list' END AS error, doc_id % 3 > 0 AS success, CASE WHEN doc_id % 3 > 0 THEN len(string_split(text, chr(10))) + 3 END AS lines FROM documents WHERE text IS NOT NULL",
)
def normalised_papers(load):
    """E9, C1."""
    rows = _items(load).filter("text is not null").withColumn("n", F.size(F.split("text", "\n")).cast("long"))
    rows = rows.withColumn("items", F.when(_doc() % 3 > 0, F.col("items")).when(_doc() % 6 == 0, F.slice("items", 1, 0)))
    got = Y.normalised_papers(rows)
    return got.select("doc_id", "error", "success", F.when(F.col("markdown").isNotNull(), F.col("n") + 3).alias("lines"))


@query("model_folders", "SELECT doc_id, 'org-model-' || doc_id || '.v_1' AS folder, 'out/org-model/task7_v1_fewshot_pct10' AS path FROM documents")
def model_folders(load):
    """T25, T26."""
    name = F.concat(F.lit("/Org\\Model -- "), _doc().cast("string"), F.lit(".V_1/"))
    return load("documents").select("doc_id", X.sanitize_model_name(name).alias("folder"), F.lit(O.output_path("out", 7, "Org/Model", "v1", fewshot=True, pct=0.1)).alias("path"))


@query("dry_runs", "SELECT conv_id, turn, 'meta' AS type, 2::INTEGER AS n FROM conversations WHERE text IS NOT NULL")
def dry_runs(load):
    """A run against the stub backend."""
    rows = load("conversations").filter("text is not null").select("conv_id", "turn", F.lit("meta").alias("type"), F.col("text").alias("prompt"))
    return G.generate(rows, G.StubBackend, n=2).select("conv_id", "turn", "type", F.size("completions").alias("n"))
