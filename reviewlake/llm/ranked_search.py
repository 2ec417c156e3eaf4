"""Ranked lexical search by a two-level quantised index (operator 13).

The documents are read once for each block of queries. A task packs up to BLOCK_DOCS documents into a block: lengths, and for
every term of the queries its postings (document, occurrences), sorted by term; terms that no query holds can't score and
aren't kept. Partial counts of documents, terms and document frequencies are summed by Spark; what is collected are as many
numbers as the query block has terms.

Level one of a block is a byte a posting: the term's saturation in that document, p = (10^9 * tf) div (1000 * tf + 8 * m),
rounded up in steps of STEP. Sums of weight * byte, term at a time into dense arrays, give each document an upper bound, and
with one step less a term a lower bound. Each task keeps every query's k highest lower bounds; the k-th of all tasks' is the
query's threshold. Level two takes every document whose upper bound reaches it and sums its exact integers. Nothing that
could be among the k best is dropped, however many documents reach the threshold; a task sends on its k best a query.

Work is in proportion to the postings of the queries' terms. A task holds one block, and dense arrays for QUERY_ROWS queries.
Queries come to the driver a block of QUERY_CHARS characters at a time; each block is one more pass over the documents.

Defined results: null and empty texts hold no term and aren't counted; an item without a term that any document holds gives no
row; texts of rows with the same item_id are one item; items with a null id are left out; documents with a null id count
and rank behind others of the same score; repeated documents count and rank as often as they stand; extra columns are
ignored; an empty table on either side gives no rows. Long texts are read in pieces of 1 MB that end where a term ends. Terms
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, joined, lean, table, word_runs

K, BLOCK_DOCS, QUERY_ROWS, QUERY_CHARS = 10, 8192, 256, 4_000_000
#: p is below 10^6, so that 255 steps hold it.
STEP = 3922
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
BLOCK = "ids binary, null_ids binary, lengths binary, ptr binary, docs binary, tf binary, frequency binary, n_docs long, n_terms long"
HIT = "query int, doc_id long, score long"


@dataclass
class Queries:
    """A block of queries: item ids, sorted term hashes, and (term, query) pairs sorted by term."""

    items: list[int]
    terms: np.ndarray
    pair_term: np.ndarray
    pair_query: np.ndarray


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def query_blocks(queries: DataFrame, chars: int = QUERY_CHARS) -> Iterator[Queries]:
    """Blocks of queries(item_id, text), in the order of their ids; one item is never split."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").orderBy("item_id")

    def block(held: list[tuple[int, str]]) -> Queries:
        items = sorted({i for i, _ in held})
        place = {i: k for k, i in enumerate(items)}
        pairs = [np.zeros((0, 2), np.uint64)]
        for item, text in held:
            for h, _, _ in word_runs(text.encode("utf-8", "surrogatepass"), GAPS):
                pairs.append(np.stack([h, np.full(len(h), place[item], np.uint64)], 1))
        both = np.unique(np.concatenate(pairs), axis=0)
        terms, term = np.unique(both[:, 0], return_inverse=True)
        return Queries(items, terms, term.astype(np.int64), both[:, 1].astype(np.int64))

    held: list[tuple[int, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if size + len(row.text or "") > chars and held and held[-1][0] != row.item_id:
            yield block(held)
            held, size = [], 0
        held.append((row.item_id, row.text or ""))
        size += len(row.text or "")
    if held:
        yield block(held)


def _index(queries: Queries):
    """Packs documents into blocks."""
    terms = queries.terms

    def postings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms a text, and (term, text, occurrences) of the queries' terms."""
        data, begins = joined(texts)
        n = np.zeros(len(texts), np.int64)
        keys = []
        for h, first, _ in word_runs(data, GAPS):
            doc = np.searchsorted(begins, first, side="right") - 1
            n += np.bincount(doc, minlength=len(texts))
            at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
            hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
            key, count = np.unique(at[hit] * len(texts) + doc[hit], return_counts=True)
            keys.append((key, count))
        if not keys:
            none = np.zeros(0, np.int64)
            return n, none, none, none
        key, inverse = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        tf = np.bincount(inverse, np.concatenate([c for _, c in keys]), len(key)).astype(np.int64)
        return n, key // len(texts), key % len(texts), tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, nulls, n, term, doc, tf = (np.concatenate(x) for x in zip(*held))
            doc = doc + np.repeat(np.cumsum([0] + [len(x[0]) for x in held[:-1]]), [len(x[3]) for x in held])
            order = np.argsort(term, kind="stable")
            frequency = np.bincount(term, minlength=len(terms))
            row = [_packed(ids), _packed(nulls), _packed(n), _packed(np.cumsum(np.concatenate([[0], frequency]))), _packed(doc[order].astype(np.int32)), _packed(tf[order]), _packed(frequency), int((n > 0).sum()), int(n.sum())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            if batch.num_rows:
                ids = batch.column("doc_id")
                found = postings(batch.column("text").to_pylist())
                held.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), *found))
            if sum(len(x[0]) for x in held) >= BLOCK_DOCS:
                yield block()
        if held:
            yield block()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) summed over a task's blocks."""
    total = None
    for batch in batches:
        for x in batch.column("frequency").to_pylist():
            one = _unpacked(x, np.int64)
            total = one if total is None else total + one
    if total is not None:
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(total[term])], ["term", "df"])


class _Block:
    """A block of the index with the saturations of its postings."""

    def __init__(self, row: dict, length: int, docs: int):
        n = _unpacked(row["lengths"], np.int64)
        self.ids, self.nulls = _unpacked(row["ids"], np.int64), _unpacked(row["null_ids"], bool)
        self.ptr, self.docs, self.tf = _unpacked(row["ptr"], np.int64), _unpacked(row["docs"], np.int32), _unpacked(row["tf"], np.int64)
        m = 10 + np.array([90 * int(x) * docs // length for x in n]) if length and n.max(initial=0) > 2**62 // (90 * max(1, docs)) else 10 + 90 * n * docs // max(1, length)
        self.p = 1_000_000_000 * self.tf // (1000 * self.tf + 8 * m[self.docs])
        self.level1 = (-(-self.p // STEP)).astype(np.uint8)


def _best(score: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then id, null ids last."""
    pick = np.flatnonzero(score > 0)
    if len(pick) > k:
        pick = pick[score[pick] >= np.partition(score[pick], len(pick) - k)[len(pick) - k]]
    return pick[np.lexsort((ids[pick], nulls[pick], -score[pick]))][:k]


def _search(queries: Queries, weights: np.ndarray, docs: int, length: int, k: int, thresholds: np.ndarray | None):
    """Without thresholds the k highest lower bounds of each query over a task's blocks (score); else its k best documents."""
    n = len(queries.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.zeros((n, k), np.int64)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, length, docs)
                for q0 in range(0, n, QUERY_ROWS):
                    q1 = min(n, q0 + QUERY_ROWS)
                    up, least = np.zeros((q1 - q0, len(b.ids)), np.int64), np.zeros((q1 - q0, len(b.ids)), np.int64)
                    mine = (queries.pair_query >= q0) & (queries.pair_query < q1)
                    for t, q in zip(queries.pair_term[mine].tolist(), (queries.pair_query[mine] - q0).tolist()):
                        lo, hi = b.ptr[t], b.ptr[t + 1]
                        if hi > lo and weights[t]:
                            part = int(weights[t]) * b.level1[lo:hi].astype(np.int64)
                            up[q, b.docs[lo:hi]] += part
                            least[q, b.docs[lo:hi]] += np.maximum(part - int(weights[t]), 0)
                    for q in range(q1 - q0):
                        if thresholds is None:
                            row_ = np.concatenate([lows[q0 + q], least[q] * STEP])
                            lows[q0 + q] = np.partition(row_, len(row_) - k)[len(row_) - k :]
                            continue
                        reach = (up[q] > 0) & (up[q] * STEP >= thresholds[q0 + q])
                        if not reach.any():
                            continue
                        exact = np.zeros(len(b.ids), np.int64)
                        for t in queries.pair_term[queries.pair_query == q0 + q].tolist():
                            at = np.arange(b.ptr[t], b.ptr[t + 1])
                            at = at[reach[b.docs[at]]]
                            exact[b.docs[at]] += int(weights[t]) * b.p[at]
                        found = [(-int(exact[i]), bool(b.nulls[i]), int(b.ids[i])) for i in _best(exact, b.ids, b.nulls, k)]
                        best[q0 + q] = sorted(best[q0 + q] + found)[:k]
        if thresholds is None:
            rows = [(q, None, int(x)) for q in range(n) for x in lows[q] if x > 0]
        else:
            rows = [(q, None if null else i, -s) for q in range(n) for s, null, i in best[q]]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    index = cut(lean(docs).mapInArrow(_index(queries), BLOCK))
    n, length = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(queries.terms), np.int64)
    for row in index.select("frequency").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[row.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * row.df + 1)))
    first = index.mapInArrow(_search(queries, weights, n, length, k, None), HIT)
    thresholds = np.zeros(len(queries.items), np.int64)
    for row in _ranked(first, k).filter(F.col("rank") == k).collect():
        thresholds[row.query] = row.score
    names = spark.createDataFrame([(q, int(i)) for q, i in enumerate(queries.items)], "query int, item_id long")
    hits = _ranked(index.mapInArrow(_search(queries, weights, n, length, k, thresholds), HIT), k)
    return hits.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, chars: int = QUERY_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item of queries(item_id, text) the k documents of docs(doc_id, text) with the highest scores above 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found: DataFrame | None = None
    for block in query_blocks(queries, chars):
        part = _one_block(docs, block, k)
        found = part if found is None else cut(found).unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLE_SQL = {
    "op13_ranked_search": r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
length AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM length),
posting AS (SELECT doc_id, term, count(*) AS tf FROM term WHERE term IN (SELECT term FROM item) GROUP BY doc_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term, docs),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN length USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
}
