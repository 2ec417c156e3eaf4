"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from reviewlake.llm import decontaminate, exact_topk, html_extract, jaccard, language_id, lm_scoring, mixing, ranked_search, secret_scan, substring_dedup, token_alignment, token_counts, toxicity

MODULES = (language_id, mixing, token_counts, toxicity, exact_topk, substring_dedup, jaccard, decontaminate, secret_scan, html_extract, token_alignment, lm_scoring, ranked_search)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
