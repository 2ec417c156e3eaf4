"""Substring dedup by sliding sentence spans (operator 6).

A sentence is a run of words up to one that ends in . ! or ?, or up to a line end. Every run of SPAN consecutive sentences is
hashed and counted globally. Of each repeated run the first occurrence (smallest doc_id, then position) stays; sentences
covered by any other occurrence go, where they come in stretches of MIN_WORDS words or more: shorter ones (greetings, labels,
a line or two that many documents use) are what ordinary documents share. With 0 for MIN_WORDS every covered sentence goes.

Runs are counted map-side before the shuffle; what is shuffled is a hash with a count and the smallest doc_id, and the
occurrences join the repeated hashes by a shuffle join that adaptive execution splits where a run is hot. Which occurrence
inside the first document is the first one is settled in that document, so no positions travel.

Defined results: null text stays null, an empty text stays empty; rows with a null doc_id are kept whole and not counted;
rows that share a doc_id are one document for the question which came first; extra columns are ignored; white space after
a removed sentence goes with it; an empty table gives no rows. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import _MULT, blocks, lean, mix, table, words

#: Sentences of a run, and words from which on a stretch of covered sentences goes.
SPAN, MIN_WORDS = 2, 24
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def sentences(texts: list[str | None]):
    """Of each sentence: text index, first byte, words, hash; then the bytes and where each text begins in them."""
    h, doc, first, last, data, begins = words(texts)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), data, begins
    raw = np.frombuffer(data, np.uint8)
    lines = np.cumsum(raw == 10)
    new = np.ones(len(h), bool)
    new[1:] = _ENDS[raw[last[:-1] - 1]] | (lines[first[1:]] != lines[first[:-1]]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    place = np.arange(len(h)) - np.repeat(at, count)
    value = np.add.reduceat(mix(h + place.astype(np.uint64) * _MULT[0]), at)
    return doc[at], first[at], count, mix(value + count.astype(np.uint64)), data, begins


def runs(doc: np.ndarray, value: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and hash of each run of span sentences."""
    m = len(doc) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(m, np.uint64(span))
    for i in range(span):
        total = mix(total + value[i : i + m] * _MULT[1])
    at = np.flatnonzero(doc[:m] == doc[span - 1 :])
    return at, total[at]


def _emit(span: int, counted: bool):
    """Rows (run, n, doc_id): map-side counts with the smallest doc_id, or each document's distinct runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["doc_id"].notna()]
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            hs, ds = [], []
            for b, e in blocks((len(t) if t else 0 for t in texts)):
                doc, _, _, value, _, _ = sentences(texts[b:e])
                at, h = runs(doc, value, span)
                hs.append(h)
                ds.append(ids[b + doc[at]])
            if not any(map(len, hs)):
                continue
            h, d = np.concatenate(hs).view(np.int64), np.concatenate(ds)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            if not counted:
                new[1:] |= d[1:] != d[:-1]
            at = np.flatnonzero(new)
            yield pd.DataFrame({"run": h[at], "n": np.diff(np.append(at, len(h))), "doc_id": d[at]})

    return run


def _remove(span: int, least: int):
    def one(text: str, first: set[int], other: set[int]) -> tuple[int, int, str]:
        doc, begin, count, value, data, _ = sentences([text])
        gone = np.zeros(len(doc) + 1, np.int64)
        seen: set[int] = set()
        at, h = runs(doc, value, span)
        for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
            if x in other or x in first and x in seen:
                gone[i] += 1
                gone[i + span] -= 1
            seen.add(x)
        bad = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(bad, prepend=not bad[0]))  # where stretches of covered and of other sentences begin
        bad &= np.repeat(np.add.reduceat(count, edge) >= least, np.diff(np.append(edge, len(bad))))
        if not bad.any():
            return len(doc), 0, text
        edge = begin.tolist() + [len(data)]
        edge[0] = 0
        kept = b"".join(data[s:e] for s, e, x in zip(edge[:-1], edge[1:], bad.tolist()) if not x)
        return len(doc), int(bad.sum()), kept.decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, total = pdf["text"].tolist(), np.zeros(len(pdf), np.int64)
            for b, e in blocks((len(t) if t else 0 for t in texts)):
                total[b:e] = np.bincount(sentences(texts[b:e])[0], minlength=e - b)
            removed, out = np.zeros(len(pdf), np.int64), list(texts)
            for i, (first, other) in enumerate(zip(pdf["first"], pdf["other"])):
                if texts[i] and (first is not None and len(first) or other is not None and len(other)):
                    _, removed[i], out[i] = one(texts[i], set() if first is None else set(first.tolist()), set() if other is None else set(other.tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_sentences": total, "n_removed": removed, "text": out})

    return run


def dedup_substrings(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) for every row of docs(doc_id, text)."""
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    emitted = "run long, n long, doc_id long"
    counts = docs.mapInPandas(_emit(span, True), emitted).groupBy("run").agg(F.sum("n").alias("total"), F.min("doc_id").alias("first_id"))
    repeated = counts.filter("total > 1").select(F.col("run").alias("again"), "first_id")
    held = docs.mapInPandas(_emit(span, False), emitted).select("run", F.col("doc_id").alias("holder"), "n")
    hits = held.join(repeated, F.col("run") == F.col("again")).filter("holder != first_id or n > 1")
    lists = hits.groupBy("holder").agg(
        F.collect_set(F.when(F.col("holder") == F.col("first_id"), F.col("run"))).alias("first"), F.collect_set(F.when(F.col("holder") != F.col("first_id"), F.col("run"))).alias("other")
    )
    joined = docs.join(lists, docs["doc_id"] == lists["holder"], "left").select("doc_id", "text", "first", "other")
    return joined.mapInPandas(_remove(span, min_words), "doc_id long, n_sentences long, n_removed long, text string")


def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentence_span_dedup": op6_sentence_span_dedup}
ORACLE_SQL = {
    # a sentence with the white space behind it: words that end nothing, then one that ends the sentence, the line or the text
    "op6_sentence_span_dedup": r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '(?:[^ \t-\r]*[^ \t-\r.!?][ \t\x0B-\r]+)*(?:[^ \t-\r]*[.!?](?:[ \t-\r]+|$)|[^ \t-\r]+(?:[ \t\x0B-\r]*\n[ \t-\r]*|[ \t-\r]*$))') AS ss FROM documents),
s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM d),
w AS (SELECT *, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM s),
k AS (SELECT doc_id, s, i, len(ws) AS n, array_to_string(ws, ' ') AS v FROM w),
r AS (SELECT *, v || chr(10) || lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
o AS (SELECT *, run IS NOT NULL AND doc_id IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM r),
c AS (SELECT *, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS covered FROM o),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, covered ORDER BY i) AS stretch FROM c),
b AS (SELECT *, covered AND sum(n) OVER (PARTITION BY doc_id, covered, stretch) >= 24 AS gone FROM g),
t AS (SELECT doc_id, count(*) AS n_sentences, count_if(gone) AS n_removed, coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT gone), '') AS kept, bool_or(gone AND i = 1) AS headless FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE CASE WHEN headless THEN '' ELSE regexp_extract(text, '^[ \t-\r]*') END || kept END AS text FROM d LEFT JOIN t USING (doc_id)"""
}
