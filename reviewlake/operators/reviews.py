"""Reviews and meta-reviews by the fields of their year (P4, P18, P19, X4), and schemas as prompt text.

A year's form is a tuple of fields. Content values come as in notes.py; a review that lacks a required field, or has a score
out of bounds, gives null. Parsed reviews are JSON texts, as forms differ from year to year.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.decisions import score_prefix
from reviewlake.functions.text import reviewer_id
from reviewlake.operators.notes import invitation_text, meta_review, official_reviews, unwrap


@dataclass(frozen=True)
class Field:
    """kind: str, int (a score with bounds), list (of str), optional (str or null), or the name of a nested form in a list."""

    name: str
    kind: str = "str"
    key: str = ""  # the name in the content, if another
    default: str | None = None  # required without one (but for list and optional)
    bounds: tuple[int, int] = (0, 0)
    about: str = ""

    @property
    def required(self) -> bool:
        return self.default is None and self.kind in ("str", "int")


# The forms of each year, in the order of their fields.
ETHICS = (Field("flag_for_ethics_review", "list"), Field("details_of_ethics_concerns", "optional"))
REVIEW_2020 = (
    Field("rating"),
    Field("review"),
    Field("title", default=""),
    Field("experience_assessment"),
    Field("review_assessment_derivations", key="review_assessment:_checking_correctness_of_derivations_and_theory"),
    Field("review_assessment_experiments", key="review_assessment:_checking_correctness_of_experiments"),
    Field("review_assessment_reading", key="review_assessment:_thoroughness_in_paper_reading"),
)
REVIEW_2021 = (Field("rating"), Field("confidence"), Field("review"), Field("title", default=""))
REVIEW_2022 = (
    *(Field(n) for n in ("recommendation", "confidence", "summary_of_the_paper", "main_review", "summary_of_the_review", "correctness", "technical_novelty_and_significance", "empirical_novelty_and_significance")),
    *ETHICS,
)
REVIEW_2023 = (
    *(Field(n) for n in ("recommendation", "confidence", "summary_of_the_paper", "strength_and_weaknesses")),
    Field("clarity_quality_novelty_reproducibility", key="clarity,_quality,_novelty_and_reproducibility"),
    *(Field(n) for n in ("summary_of_the_review", "correctness", "technical_novelty_and_significance", "empirical_novelty_and_significance")),
    *ETHICS,
)
REVIEW_2024 = (
    Field("rating", "int", bounds=(0, 10)),
    Field("confidence", "int", bounds=(1, 5)),
    *(Field(n) for n in ("summary", "strengths", "weaknesses", "questions")),
    *(Field(n, "int", bounds=(1, 4)) for n in ("soundness", "presentation", "contribution")),
    *ETHICS,
    Field("code_of_conduct", default="Yes"),
)
META_2020 = (Field("decision"), Field("comment", default=""), Field("title", default="Paper Decision"))
META_2023 = (
    Field("decision"),
    Field("metareview_summary_strengths_weaknesses", key="metareview:_summary,_strengths_and_weaknesses"),
    Field("justification_for_why_not_higher_score"),
    Field("justification_for_why_not_lower_score"),
    Field("summary_of_AC_reviewer_meeting", "optional", key="summary_of_AC-reviewer_meeting"),
    Field("note_from_PC", "optional"),
    Field("title", default="Paper Decision"),
)
META_2024 = (Field("metareview"), Field("justification_for_why_not_higher_score", default=""), Field("justification_for_why_not_lower_score", default=""))
META_2025 = (Field("metareview", default=""), Field("additional_comments_on_reviewer_discussion", "optional"))
REVIEW_FORMS = {2020: REVIEW_2020, 2021: REVIEW_2021, 2022: REVIEW_2022, 2023: REVIEW_2023, 2024: REVIEW_2024, 2025: REVIEW_2024, 2026: REVIEW_2024}
META_FORMS = {2020: META_2020, 2021: META_2020, 2022: META_2020, 2023: META_2023, 2024: META_2024, 2025: META_2025, 2026: META_2025}

# The forms that completions are held against, with the texts that prompts show.
SOURCE = (Field("ref", about="Link or title of referenced paper"), Field("within", about="Which field: 'summary', 'strengths', 'weaknesses', 'questions'"))
UNIVERSAL_REVIEW = (
    Field("summary", about="Main summary/points of the review"),
    Field("strengths", about="Paper strengths identified by reviewer"),
    Field("weaknesses", about="Paper weaknesses identified by reviewer"),
    Field("questions", "list", about="Questions for authors"),
    Field("sources", "Source", about="Papers/sources mentioned in the review"),
    Field("technical_novelty_contribution", "optional", about="Technical novelty assessment (if mentioned)"),
    Field("empirical_novelty_contribution", "optional", about="Empirical contribution assessment (if mentioned)"),
    Field("presentation", "optional", about="Presentation quality assessment (if mentioned)"),
)
UNIVERSAL_META = (
    Field("summary", about="Main summary/assessment from AC"),
    Field("strengths", about="Identified strengths"),
    Field("weaknesses", about="Identified weaknesses"),
    Field("why_not_higher", "optional", about="Justification for not higher score (if present)"),
    Field("why_not_lower", "optional", about="Justification for not lower score (if present)"),
)
NESTED = {"Source": SOURCE}


def json_value(c: Column) -> Column:
    """One value as JSON; null as null."""
    held = F.to_json(F.array(c))
    return F.substr(held, F.lit(2), F.length(held) - 2)


def _object(values: dict[str, Column], lists: set[str], pretty: bool) -> Column:
    """The values as a JSON object, in order; pretty: a line each, two spaces deep, as prompts show it."""
    if not pretty:
        return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})

    def shown(name: str, value: Column) -> Column:
        if name in lists:
            inner = F.array_join(F.transform(value, json_value), ",\n    ")
            value = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[\n    "), inner, F.lit("\n  ]")))
        else:
            value = json_value(value)
        return F.concat(F.lit(f'  "{name}": '), value)

    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *[shown(k, v) for k, v in values.items()]), F.lit("\n}"))


def parse_form(content: Column, form: tuple[Field, ...], more: dict[str, Column] | None = None, pretty: bool = False) -> Column:
    """The content as JSON with the form's fields and more; null if it isn't valid."""
    valid, values = F.lit(True), {}
    for f in form:
        raw = unwrap(content, f.key or f.name)
        raw = F.coalesce(raw, unwrap(content, f.name)) if f.key else raw
        if f.kind == "int":
            values[f.name] = score_prefix(raw)
            valid &= F.coalesce(values[f.name].between(*f.bounds), F.lit(False))
        elif f.kind == "list":
            parsed = F.from_json(raw, "array<string>")
            values[f.name] = F.coalesce(parsed, F.array().cast("array<string>"))
            valid &= raw.isNull() | parsed.isNotNull()
        else:
            values[f.name] = raw if f.default is None else F.coalesce(raw, F.lit(f.default))
            valid &= raw.isNotNull() if f.required else F.lit(True)
    return F.when(valid, _object({**values, **(more or {})}, {f.name for f in form if f.kind == "list"}, pretty))


def _by_year(year: Column, forms: dict[int, tuple[Field, ...]], parse) -> Column:
    out = F.lit(None).cast("string")
    for form in dict.fromkeys(forms.values()):
        out = F.when(year.isin(*[y for y, f in forms.items() if f == form]), parse(form)).otherwise(out)
    return out


def response_counts(review: Column, replies: Column) -> tuple[Column, Column]:
    """J9 inside one note: authors' comments on a review (distinct ids), and the same reviewer's comments on those."""
    names = lambda r: F.array_join(F.coalesce(r["signatures"], F.array().cast("array<string>")), ",")
    comments = F.filter(replies, lambda r: F.contains(invitation_text(r), F.lit("Official_Comment")))
    answers = F.array_distinct(F.transform(F.filter(comments, lambda c: F.contains(names(c), F.lit("Authors")) & (c["replyto"] == review["id"])), lambda c: c["id"]))
    who = reviewer_id(F.get(review["signatures"], 0))
    back = F.filter(comments, lambda c: F.coalesce(F.contains(names(c), who) & F.array_contains(answers, c["replyto"]), F.lit(False)))
    known = review["id"] != ""
    return F.when(known, F.size(answers)).otherwise(0), F.when(known & who.isNotNull(), F.size(back)).otherwise(0)


def parse_review(content: Column, year: Column, author_responses: Column | None = None, reviewer_responses: Column | None = None, pretty: bool = False) -> Column:
    """A review as JSON of its year's form, with the counts of responses; null if it isn't valid or the year has no form."""
    zero = F.lit(0)
    more = {"number_of_author_responses": zero if author_responses is None else author_responses, "number_of_reviewer_responses_to_author": zero if reviewer_responses is None else reviewer_responses}
    return _by_year(year, REVIEW_FORMS, lambda form: parse_form(content, form, more, pretty))


def parse_meta(content: Column, year: Column, pretty: bool = False) -> Column:
    """A meta-review as JSON of its year's form; null if it isn't valid."""
    return _by_year(year, META_FORMS, lambda form: parse_form(content, form, None, pretty))


def note_reviews(replies: Column, year: Column, pretty: bool = False) -> Column:
    """The valid official reviews of a note's replies, parsed, in order."""
    replies = F.coalesce(replies, F.array())
    each = F.transform(official_reviews(replies), lambda r: parse_review(r["content"], year, *response_counts(r, replies), pretty))
    return F.filter(each, lambda x: x.isNotNull())


def note_meta(replies: Column, year: Column, pretty: bool = False) -> Column:
    """struct(json, error): the parsed meta-review, null without one; error if there is one that isn't valid."""
    found = meta_review(F.coalesce(replies, F.array()), year)
    parsed = F.when(found.isNotNull(), parse_meta(found["content"], year, pretty))
    return F.struct(parsed.alias("json"), (found.isNotNull() & parsed.isNull()).alias("error"))


# --- X5: forms as text ----------------------------------------------------------------------------------------------------

_TYPES = {"str": "str", "int": "int", "list": "list of str", "optional": "str or null"}


def form_text(form: tuple[Field, ...], indent: int = 0) -> str:
    """A line a field: name, type, whether it is required, and what it is; nested forms below their field."""
    lead, lines = "  " * indent, []
    for f in form:
        lines.append(f"{lead}- {f.name}: {_TYPES.get(f.kind, f'list of {f.kind}')} ({'required' if f.required else 'optional'})" + (f" - {f.about}" if f.about else ""))
        if f.kind in NESTED:
            lines += [f"{lead}  Fields for {f.kind}:", form_text(NESTED[f.kind], indent + 2)]
    return "\n".join(lines)


def form_example(form: tuple[Field, ...]) -> str:
    """An example of the form as indented JSON."""
    blank = {"int": 0, "list": ["..."]}
    return json.dumps({f.name: [{n.name: "..." for n in NESTED[f.kind]}] if f.kind in NESTED else blank.get(f.kind, "...") for f in form}, indent=2)


def form_schema(form: tuple[Field, ...]) -> str:
    """The form as a Spark schema."""
    kinds = {"int": "int", "list": "array<string>"}
    nested = {n: f"array<struct<{', '.join(f'{f.name}: string' for f in fs)}>>" for n, fs in NESTED.items()}
    return ", ".join(f"{f.name} {nested.get(f.kind) or kinds.get(f.kind, 'string')}" for f in form)
