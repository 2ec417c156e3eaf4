"""Prompts for the normaliser (P16, E2) and for the legacy prediction tasks (P17, E3), as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import decisions as D
from reviewlake.functions import text as X
from reviewlake.operators.notes import first_valid_json
from reviewlake.operators.reviews import UNIVERSAL_META, UNIVERSAL_REVIEW, form_example, form_schema, form_text, note_meta, note_reviews
from reviewlake.operators.submissions import bullet_list

# The prompts' wording.
NORMALISE = """Extract and normalize this ICLR review into a structured JSON format. This is a structuring task
do not hallucinate details unpresent in the original. Leave fields unfilled if no details are present. Fill fields
if there is evidence in the original.

Original {kind}:
{original}

Output a JSON object with these fields:
{fields}

Example output format:
{example}

JSON:"""
EXAMPLES = "\n\nHere are some examples:\n\n"
PAPER = "Title: {title}\n\nAbstract: {abstract}"
ANSWER = "\n\nProvide your response in the following format{how}:\nReasoning: [{reasoning}]\nAnswer: [{answer}]"
TASK_1 = (
    """You are an expert reviewer for the ICLR {year} conference. Based on the paper's title and abstract, predict the final decision.{examples}

Now predict for this paper:

"""
    + PAPER
    + """

Possible decisions:
{decisions}"""
    + ANSWER.replace("{how}", "").replace("{reasoning}", "Your reasoning about the paper's quality, novelty, and fit").replace("{answer}", "Exact decision string from the list above")
)
TASK_2 = (
    """You are an expert at predicting research impact. Based on the paper's title and abstract, predict how many citations it will receive at different time horizons.{examples}

Now predict for this paper:

"""
    + PAPER
    + """

Publication year: {published}

Predict the citation count at the following horizons: {horizons} after publication.

IMPORTANT: Provide citations PER YEAR (not cumulative sum). For example, if a paper gets 10 citations in year 1 and 15 MORE in year 2, respond with "10,15" not "10,25"."""
    + ANSWER.replace("{how}", "").replace("{reasoning}", "Your assessment of the paper's potential impact and why").replace("{answer}", 'Comma-separated integers (e.g., "5,12,25,45,67,89"), exactly {count} numbers')
)
TASK_3 = (
    """You are an expert ICLR reviewer. Rate this paper's quality on a scale from 1-10.{examples}

Now rate this paper:

"""
    + PAPER
    + """

Rating scale:
1-2: Strong rejection (trivial or wrong)
3-4: Clear rejection (not good enough)
5: Marginally below acceptance threshold
6: Marginally above acceptance threshold
7-8: Good paper, clear accept
9-10: Outstanding paper, strong accept"""
    + ANSWER.replace("{how}", "").replace("{reasoning}", "Your assessment of the paper's quality, strengths, and weaknesses").replace("{answer}", "Single number from 1-10")
)
TASK_5 = (
    """You are an expert at assessing research impact. Based on this paper's title and abstract, estimate its citation impact percentile.{examples}

Now assess this paper:

"""
    + PAPER
    + """

If you consider 1000 papers in the same research area as this paper, what percentile would this paper's citations be at?

- 0.0 = bottom percentile (least cited)
- 0.5 = median
- 0.9 = top 10%
- 1.0 = top percentile (most cited)"""
    + ANSWER.replace("{how}", "").replace("{reasoning}", "Your assessment of why this paper will have high/low citation impact").replace("{answer}", 'Decimal number between 0.0 and 1.0 (e.g., "0.75")')
)
TASK_6 = (
    """You are an expert ICLR reviewer. Based on this paper's title and abstract, estimate what its confidence-weighted average review score would be.{examples}

Now assess this paper:

"""
    + PAPER
    + """

Assume 3-4 reviewers rate this paper, each with different confidence levels. Higher confidence reviewers' scores are weighted more heavily. Estimate the final confidence-weighted average quality score, normalized to 0-1 scale.

- 0.0 = worst possible quality
- 0.5 = borderline paper
- 1.0 = exceptional quality"""
    + ANSWER.replace("{how}", "").replace("{reasoning}", "Your assessment of the paper's quality and likely reviewer consensus").replace("{answer}", 'Decimal number between 0.0 and 1.0 (e.g., "0.65")')
)
TASK_7 = (
    """You are an expert reviewer for the ICLR conference. Based on {source}, predict whether it will be accepted or rejected.{examples}

Now predict for this paper:

Year: ICLR {year}
Title: {title}

{content}"""
    + ANSWER.replace("{how}", ", try to be critical").replace("{reasoning}", "Your reasoning about the paper's quality, novelty, and fit").replace("{answer}", 'Either "Accept" or "Reject"')
)
# Fallbacks of examples without usable scores, limits, and the year that ages count to.
FALLBACK_SCORE, FALLBACK_QUALITY, MOST_EXAMPLES, PAPER_TOKENS, NOW = 7.0, 0.65, 3, 18_000, 2025


def fill(template: str, **values: Column | str) -> Column:
    """The template with columns (or texts) in place of its {names}."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else (v.cast("string") if isinstance(v := values[p], Column) else F.lit(v)) for i, p in enumerate(parts)])


def normaliser_prompts(notes: DataFrame) -> DataFrame:
    """A row a review (review_index from 0) and one for the meta-review (-1) of notes(id, year, md_path, replies)."""
    replies, year = F.col("replies"), F.col("year")

    def rows(kind: str, originals: Column, form) -> Column:
        shown = "Review" if kind == "review" else "Meta-Review"
        prompt = lambda x: fill(NORMALISE, kind=shown, original=x, fields=form_text(form), example=form_example(form))
        return F.transform(originals, lambda x, i: F.struct(F.lit(kind).alias("type"), (i if kind == "review" else F.lit(-1)).alias("review_index"), x.alias("original_json"), prompt(x).alias("prompt")))

    meta = note_meta(replies, year, pretty=True)["json"]
    both = F.concat(rows("review", note_reviews(replies, year, pretty=True), UNIVERSAL_REVIEW), rows("meta", F.array_compact(F.array(meta)), UNIVERSAL_META))
    return notes.select(F.col("id").alias("submission_id"), "year", "md_path", F.explode(both).alias("p")).select("submission_id", "year", "md_path", "p.*")


def normalised_rows(generated: DataFrame) -> DataFrame:
    """The 13 columns of normaliser_prompts() rows with completions ARRAY, num_generated_tokens and metrics
    STRUCT<arrival_time, last_token_ts>: the first completion that fits its type's form, and the time taken."""
    forms = {"review": UNIVERSAL_REVIEW, "meta": UNIVERSAL_META}
    found = {k: first_valid_json(F.col("completions"), form_schema(f), [x.name for x in f if x.required]) for k, f in forms.items()}
    normalised = F.when(F.col("type") == "review", F.to_json(found["review"], {"ignoreNullFields": "false"})).otherwise(F.to_json(found["meta"], {"ignoreNullFields": "false"}))
    return generated.withColumn("normalized_json", normalised).select(
        "submission_id",
        "year",
        "md_path",
        "type",
        "review_index",
        "original_json",
        "prompt",
        F.col("completions").alias("generated_texts"),
        "normalized_json",
        F.col("normalized_json").isNotNull().alias("parse_success"),
        "num_generated_tokens",
        D.latency(F.col("metrics.arrival_time"), F.col("metrics.last_token_ts")).alias("time_taken_llm"),
        "metrics",
    )


def _examples(examples: Column, body: Callable[[Column], Column], most: int | None = None) -> Column:
    """The block of numbered examples; empty without any."""
    held = examples if most is None else F.slice(examples, 1, most)
    each = F.transform(held, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), body(x), F.lit("\n\n")))
    return F.when(F.size(F.coalesce(examples, F.array())) > 0, F.concat(F.lit(EXAMPLES), F.array_join(each, ""))).otherwise("")


def _mean_score(x: Column) -> Column:
    """Mean of an example's scores, a JSON list with nulls left out; null if there is none."""
    return D.mean_score(F.array_compact(F.from_json(x["extracted_scores"], "array<double>")))


def _paper(x: Column, answer: Column) -> Column:
    return fill(PAPER + "\n\nAnswer: {answer}", title=x["title"], abstract=x["abstract"], answer=answer)


def _reasoned(x: Column, reasoning: Column, answer: Column) -> Column:
    return fill(PAPER + "\n\nReasoning: {reasoning}\n\nAnswer: {answer}", title=x["title"], abstract=x["abstract"], reasoning=reasoning, answer=F.format_string("%.2f", answer))


def _either(high: Column, yes: str, no: str) -> Column:
    return F.when(high, yes).otherwise(no)


def prediction_prompt(task: int, examples: Column | None = None, decisions: Column | None = None, paper: Column | None = None) -> Column:
    """The prompt of tasks 1, 2, 3, 5, 6 or 7 over columns year, title and abstract.

    examples are structs (title, abstract, year, paper_decision, gs_citation_copy, extracted_scores JSON, Accepted); tasks 2 to 6 show
    the first three. decisions (task 1) lists the year's decisions; paper (task 7) is the paper's text, read in place of the
    abstract where it is there, without examples.
    """
    held = F.array() if examples is None else examples
    title, abstract, year = F.col("title"), F.col("abstract"), F.col("year")
    known = dict(title=title, abstract=abstract, year=year)
    none = F.lit("")

    def block(body, most=MOST_EXAMPLES):
        return none if examples is None else _examples(held, body, most)

    if task == 1:
        shown = block(lambda x: _paper(x, F.coalesce(x["paper_decision"], F.lit("Unknown"))), None)
        return F.when(F.size(decisions) > 0, fill(TASK_1, examples=shown, decisions=bullet_list(decisions), **known)).otherwise("No decisions available for this year")
    if task == 2:
        ahead = D.horizons(F.lit(NOW) - year + 1)
        names = F.array_join(F.transform(ahead, lambda h: F.concat(h.cast("string"), F.when(h > 1, " years").otherwise(" year"))), ", ")
        cited = lambda x: F.coalesce(x["gs_citation_copy"].cast("double").cast("long"), F.lit(10)).cast("string")
        shown = block(lambda x: _paper(x, F.concat(cited(x), F.lit(" citations at horizon "), F.least(F.lit(NOW) - x["year"].cast("int") + 1, F.lit(6)).cast("string"))))
        return F.when(F.size(ahead) > 0, fill(TASK_2, examples=shown, published=year - 1, horizons=names, count=F.size(ahead), **known)).otherwise("No valid horizons")
    if task == 3:
        return fill(TASK_3, examples=block(lambda x: _paper(x, F.coalesce(F.bround(_mean_score(x), 1), F.lit(FALLBACK_SCORE)).cast("string"))), **known)
    if task == 5:
        def impact(x: Column) -> Column:
            p = D.citation_percentile(F.coalesce(x["gs_citation_copy"].cast("double"), F.lit(10.0)))
            words = "This paper addresses {problem} with {insight}. Expected {impact} citation impact."
            reason = fill(words, problem=_either(p > 0.7, "a fundamental problem", "an interesting problem"), insight=_either(p > 0.7, "novel insights", "a reasonable approach"), impact=_either(p > 0.7, "high", "moderate"))
            return _reasoned(x, reason, p)

        return fill(TASK_5, examples=block(impact), **known)
    if task == 6:
        def quality(x: Column) -> Column:
            q = F.coalesce(D.quality(_mean_score(x)), F.lit(FALLBACK_QUALITY))
            words = "This paper presents {work} work. Reviewers would likely {agree}. Expected confidence-weighted score reflects {verdict}."
            reason = fill(words, work=_either(q > 0.7, "strong", "solid"), agree=_either(q > 0.7, "agree on high quality", "find it acceptable"), verdict=_either(q > 0.7, "strong accept", "borderline accept"))
            return _reasoned(x, reason, q)

        return fill(TASK_6, examples=block(quality), **known)
    if task == 7:
        body = lambda x: F.concat(F.lit("Year: ICLR "), F.coalesce(x["year"].cast("string"), F.lit("Unknown")), F.lit("\n"), _paper(x, F.when(F.coalesce(x["Accepted"], F.lit(True)), "Accept").otherwise("Reject")))
        short = F.concat(F.lit("Abstract: "), F.coalesce(abstract, none))
        if paper is None:
            return fill(TASK_7, source="the paper's title and abstract", examples=block(body, None), content=short, title=title, year=year)
        content = F.coalesce(F.concat(F.lit("Paper Content:\n"), X.truncate(paper, PAPER_TOKENS)), short)
        source = F.when(paper.isNotNull(), "the full paper content").otherwise("the paper's title and abstract")
        return fill(TASK_7, source=source, examples="", content=content, title=title, year=year)
    raise ValueError(f"there is no task {task}")


def predicted_rows(generated: DataFrame, task: int, decisions: Column | None = None) -> DataFrame:
    """The 8 columns of a prediction run over rows with generated_text, original_index, prompt, num_generated_tokens, metrics and year."""
    text = F.col("generated_text")
    answers = {
        1: lambda: X.answer_choice(text, decisions),
        2: lambda: F.to_json(X.answer_counts(text, 6)),
        3: lambda: X.answer_rating(text).cast("string"),
        5: lambda: X.answer_ratio(text).cast("string"),
        6: lambda: X.answer_ratio(text).cast("string"),
        7: lambda: X.answer_decision(text),
    }
    answer = answers[task]() if task in answers else F.lit(None).cast("string")
    return generated.select(
        "generated_text",
        F.struct(X.reasoning(text).alias("reasoning"), answer.alias("answer")).alias("extracted_decision"),
        "original_index",
        F.lit(task).alias("indicator"),
        "prompt",
        "num_generated_tokens",
        "metrics",
        D.latency(F.col("metrics.arrival_time"), F.col("metrics.last_token_ts")).alias("time_taken_llm"),
    )
