"""Submission notes, reviews and prompts.

A note has content MAP<STRING, STRING> whose values are plain or, in the newer API, {"value": ...} as JSON; replies are
ARRAY<STRUCT<id, replyto, signatures ARRAY<STRING>, invitation STRING, invitations ARRAY<STRING>, content MAP<STRING, STRING>>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_REVIEWS = 12
# Names that submissions use for the same field.
TLDR_KEYS = ("TLDR", "TL;DR", "one-sentence_summary")
AREA_KEYS = ("primary_area", "Please_choose_the_closest_area_that_your_submission_falls_into")
#: Rating field by year: (field, least, most); null bounds are unchecked.
RATING_FIELD = {2020: "rating", 2021: "rating", 2022: "recommendation", 2023: "recommendation", 2024: "rating", 2025: "rating", 2026: "rating"}


def unwrap(content: Column, key: str) -> Column:
    """A value of either API version; null if missing."""
    raw = F.element_at(content, F.lit(key))
    return F.when(raw.rlike(r'^\s*\{\s*"value"\s*:'), F.get_json_object(raw, "$.value")).otherwise(raw)


def first_filled(content: Column, *keys: str) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*[F.nullif(unwrap(content, k), F.lit("")) for k in keys])


def invitation_text(reply: Column) -> Column:
    """All invitations of a reply as one text."""
    return F.coalesce(F.nullif(reply["invitation"], F.lit("")), F.array_join(reply["invitations"], ","), F.lit(""))


def official_reviews(replies: Column) -> Column:
    """Replies that are official reviews, in order."""
    return F.filter(F.coalesce(replies, F.array()), lambda r: F.contains(invitation_text(r), F.lit("Official_Review")))


def meta_review(replies: Column, year: Column) -> Column:
    """The first decision up to 2023, from 2024 the first meta-review that isn't a decision."""
    inv = lambda r, word: F.contains(invitation_text(r), F.lit(word))
    return F.get(F.filter(replies, lambda r: F.when(year <= 2023, inv(r, "Decision")).otherwise(inv(r, "Meta_Review") & ~inv(r, "Decision"))), 0)


def note_decision(replies: Column, venue: Column) -> Column:
    """The first decision reply that isn't empty, normalised; else what the venue says."""
    from reviewlake.functions.decisions import normalize_decision, venue_decision

    texts = F.transform(F.filter(F.coalesce(replies, F.array()), lambda r: F.contains(invitation_text(r), F.lit("Decision"))), lambda r: F.coalesce(unwrap(r["content"], "decision"), unwrap(r["content"], "recommendation"), F.lit("")))
    found = normalize_decision(F.get(F.filter(texts, lambda t: t != ""), 0))
    return F.when(found != "Unknown", found).otherwise(venue_decision(venue))


def reviews_columns(reviews: Column, most: int = MAX_REVIEWS) -> list[Column]:
    """P5: review_1 ... review_12; nulls after the last, reviews after the twelfth dropped."""
    return [F.get(reviews, F.lit(i)).alias(f"review_{i + 1}") for i in range(most)]


def all_or_null(reviews: Column) -> Column:
    """The array if it has elements and all are there, else null."""
    return F.when((F.size(reviews) > 0) & F.forall(reviews, lambda r: r.isNotNull()), reviews)


def technical_indicators(decision: Column, citations: Column, ratings: Column) -> Column:
    """Binary and exact decision, citations (0 if unknown) and ratings."""
    binary = F.when(F.startswith(decision, F.lit("Accept")), "accept").otherwise("reject")
    return F.struct(binary.alias("binary_decision"), decision.alias("specific_decision"), F.coalesce(citations, F.lit(0)).alias("citations"), ratings.alias("ratings"))


def valid_images(count: Column, page_end: Column) -> Column:
    """one image a page."""
    return (count == page_end + 1) & (page_end >= 0)


def valid_paper(page_end: Column, has_abstract: Column, has_references: Column) -> Column:
    """F4."""
    return (page_end > 0) & has_abstract & has_references


def bounded_score(c: Column, least: int, most: int) -> Column:
    """The score's whole-number prefix if it is in bounds, else null."""
    from reviewlake.functions.decisions import score_prefix

    x = score_prefix(c)
    return F.when(x.between(least, most), x)


def first_valid_json(completions: Column, schema: str, required: list[str]) -> Column:
    """The first completion whose JSON has all required fields, plain or inside "properties"; null if none has."""
    from reviewlake.functions.text import outer_json

    def parsed(text: Column) -> Column:
        plain = F.from_json(text, schema)
        inner = F.from_json(F.get_json_object(text, "$.properties"), schema)
        good = lambda s: F.array_compact(F.array(*[s[k].isNotNull().cast("int") for k in required])) == F.array(*[F.lit(1)] * len(required))
        return F.when(good(plain), plain).when(good(inner), inner)

    return F.get(F.filter(F.transform(completions, lambda t: parsed(outer_json(t))), lambda s: s.isNotNull()), 0)


def prompt_rows(reviews: Column, meta: Column) -> Column:
    """One struct (type, review_index, original) a review, and one with index -1 for the meta-review."""
    each = F.transform(reviews, lambda r, i: F.struct(F.lit("review").alias("type"), i.alias("review_index"), r.alias("original")))
    last = F.array(F.struct(F.lit("meta_review").alias("type"), F.lit(-1).alias("review_index"), meta.alias("original")))
    return F.concat(each, F.when(meta.isNotNull(), last).otherwise(F.slice(last, 1, 0)))
