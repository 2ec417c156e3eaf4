"""Text column functions. Every function takes and returns columns, and stays inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker and ratio of characters to tokens of the truncation rule.
TRUNCATION_MARK = "\n\n[... truncated for length ...]"
CHARS_PER_TOKEN = 53e3 / 15e3


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def title_key(c: Column) -> Column:
    """Lower case, only a-z and 0-9; null is the word none."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit("None"))), "[^a-z0-9]", "")


def clean_header(c: Column) -> Column:
    """T5: without span elements and asterisks, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?i)<span[^>]*>.*?</span>", ""), r"\*+", ""))


def normalize_whitespace(c: Column) -> Column:
    """Lines without trailing white space, one blank line at most in a row, ends trimmed."""
    bare = F.regexp_replace(c, r"(?U)[^\S\n]+(?=\n|$)", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])(?U:\s)+")


def drop_sentences(c: Column, pattern: str) -> Column:
    """Sentences that match the pattern go; the others are joined by one space."""
    return F.array_join(F.filter(sentences(c), lambda s: ~s.rlike(pattern)), " ")


def anonymize_abstract(c: Column) -> Column:
    """No sentence with https://github; white space squeezed."""
    return squeeze(drop_sentences(c, "(?i)https://github"))


def remove_git_sentences(c: Column) -> Column:
    """No sentence with an https link to a git host; inner white space stays."""
    return strip(drop_sentences(c, r"(?is)https:\s*//.*git"))


def remove_code_links(c: Column) -> Column:
    """No sentence that has code and then a github link."""
    return F.regexp_replace(c, r"(?i)(?:(?<=\.)|^)(?U:\s)*[^.]*code[^.]*https?://github[^\s)]*[^.]*\.?", "")


def truncate(c: Column, max_tokens: int) -> Column:
    """Cut to the characters of max_tokens, with a mark."""
    n = int(max_tokens * CHARS_PER_TOKEN)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(TRUNCATION_MARK))).otherwise(c)


def mentions_github_link(c: Column) -> Column:
    """F11, first form: a github.com/ path."""
    return F.contains(F.lower(c), F.lit("github.com/"))


def mentions_github(c: Column) -> Column:
    """F11, second form: the word anywhere."""
    return F.contains(F.lower(c), F.lit("github"))


def reviewer_id(signature: Column) -> Column:
    """The last path segment that names a reviewer."""
    return F.try_element_at(F.filter(F.split(signature, "/"), lambda s: F.contains(s, F.lit("Reviewer"))), F.lit(-1))


def sanitize_model_name(c: Column) -> Column:
    """A name that is safe in paths: lower case, odd characters to single hyphens, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?:[^a-zA-Z0-9_.-]|-)+", "-")), "^-+|-+$", "")


def model_folder(name: str) -> str:
    """T25 on a string."""
    return re.sub(r"(?:[^a-zA-Z0-9_.-]|-)+", "-", name).lower().strip("-")


def pdf_hash(path: Column) -> Column:
    """Last segment without .pdf of a /pdf/ path, else the empty string."""
    return F.when(F.startswith(path, F.lit("/pdf/")), F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), r"\.pdf$", "")).otherwise("")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), r"\.[^.]*$", "")


def outer_json(c: Column) -> Column:
    """From the first { to the last }; null without both in this order."""
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((first > 0) & (F.instr(c, "}") > 0) & (last > first), F.substr(c, first, last - first + 1))


def reasoning(c: Column) -> Column:
    """Text after Reasoning: up to Answer: or the end."""
    return F.nullif(strip(F.regexp_extract(c, r"(?isd)Reasoning:\s*(.+?)(?=Answer:|$)", 1)), F.lit(""))


def answer(c: Column) -> Column:
    """Text after Answer:, up to the line end."""
    return F.nullif(strip(F.regexp_extract(c, r"(?id)Answer:[ \t]*\n?(.+)", 1)), F.lit(""))


def answer_decision(c: Column) -> Column:
    """T31, task 7: accept wins over reject."""
    a = F.lower(F.coalesce(answer(c), F.lit("")))
    return F.when(F.contains(a, F.lit("accept")), "Accept").when(F.contains(a, F.lit("reject")), "Reject")


def answer_choice(c: Column, choices: Column) -> Column:
    """T31, task 1: the equal choice, else the first equal but for case, else the first where one holds the other."""
    a = F.coalesce(answer(c), F.lit(""))
    low = F.lower(a)
    exact = F.when(F.array_contains(choices, a), a)
    near = F.get(F.filter(choices, lambda d: F.lower(d) == low), 0)
    part = F.get(F.filter(choices, lambda d: F.contains(low, F.lower(d)) | F.contains(F.lower(d), low)), 0)
    return F.coalesce(exact, near, part)


def answer_counts(c: Column, n: int) -> Column:
    """T31, task 2: the first n whole numbers, nulls after them."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer(c), F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(found, i))


def answer_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(answer(c), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def answer_rating(c: Column) -> Column:
    """T31, task 3: a number from 1 to 10."""
    x = answer_number(c)
    return F.when(x.between(1, 10), x)


def answer_ratio(c: Column) -> Column:
    """T31, tasks 5 and 6: a share; numbers over 1 are percentages."""
    x = answer_number(c)
    x = F.when(x > 1, x / 100).otherwise(x)
    return F.when(x.between(0, 1), x)
