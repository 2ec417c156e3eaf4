"""Decisions, scores and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCLUDED = ("Withdrawn", "Desk Reject")


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def normalize_decision(c: Column) -> Column:
    """One of seven values; the most specific word wins."""
    d = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_has(d, "oral", "talk", "notable-top-5%"), "Accept (Oral)")
        .when(_has(d, "spotlight", "notable-top-25%"), "Accept (Spotlight)")
        .when(_has(d, "poster") | (_has(d, "accept") & ~_has(d, "reject")), "Accept (Poster)")
        .when(_has(d, "desk") & _has(d, "reject"), "Desk Reject")
        .when(_has(d, "reject"), "Reject")
        .when(_has(d, "withdraw"), "Withdrawn")
        .otherwise("Unknown")
    )


def venue_decision(c: Column) -> Column:
    """The decision that a venue names."""
    v = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_has(v, "oral", "notable top 5%"), "Accept (Oral)")
        .when(_has(v, "spotlight", "notable top 25%"), "Accept (Spotlight)")
        .when(_has(v, "poster"), "Accept (Poster)")
        .when(_has(v, "desk reject"), "Desk Reject")
        .when(_has(v, "reject"), "Reject")
        .when(_has(v, "withdraw"), "Withdrawn")
        .otherwise("Unknown")
    )


def coarse_decision(c: Column) -> Column:
    """Withdrawn, Accept, Reject or Unknown; withdrawal first."""
    d = F.lower(F.coalesce(c, F.lit("")))
    accept = _has(d, "accept", "poster", "spotlight", "oral")
    return F.when(_has(d, "withdraw"), "Withdrawn").when(_has(d, "reject"), "Reject").when(accept, "Accept").otherwise("Unknown")


def classify_decision(c: Column) -> Column:
    """Accept, Reject or Undecided."""
    d = F.lower(F.coalesce(c, F.lit("")))
    return F.when(_has(d, "accept"), "Accept").when(_has(d, "reject"), "Reject").otherwise("Undecided")


def reviewable(decision: Column) -> Column:
    """neither withdrawn nor desk-rejected."""
    return ~decision.isin(*EXCLUDED)


def keep_in_manifest(decision: Column, year: Column) -> Column:
    """F8: no withdrawn ones; unknown ones only of 2026."""
    return (decision != "Withdrawn") & ((decision != "Unknown") | (year == 2026))


def score_prefix(c: Column) -> Column:
    """The whole number that a score text starts with; null without one."""
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d+)", 1).try_cast("int")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, half to even; null for an empty whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def horizons(age: Column, most: int = 6) -> Column:
    """1 to the age in years, at most six; empty for age 0."""
    return F.when(age >= 1, F.sequence(F.lit(1), F.least(age, F.lit(most)))).otherwise(F.array().cast("array<int>"))


def mean_score(scores: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def quality(mean: Column) -> Column:
    """A mean rating from 1 to 10 as a share."""
    return (mean - 1) / 9


def citation_percentile(citations: Column) -> Column:
    """Citations over 100, held between 0.1 and 0.95."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), citations / 100.0))


def from_millis(c: Column) -> Column:
    """Epoch milliseconds to a timestamp; 0 and null to null."""
    return F.when(c != 0, F.timestamp_millis(c))


def epoch_seconds(c: Column) -> Column:
    """Seconds of a timestamp after 1970."""
    return F.when(F.unix_micros(c.cast("timestamp")) > 0, F.unix_timestamp(c))


def latency(first: Column, last: Column) -> Column:
    """Seconds between two times, if both are there."""
    return F.when(first.isNotNull() & last.isNotNull(), last - first)
