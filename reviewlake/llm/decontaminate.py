"""Benchmark decontamination (operator 8): shared n-grams as an exact filter, then Smith-Waterman alignment.

Test items are the small side: they are taken in blocks of about BLOCK_CHARS characters, each indexed by all its pairs of
words and broadcast by itself, so neither the driver nor a worker ever holds more than a block. One pass a block (one in all
for up to BLOCK_CHARS of items) looks the pairs of every whole document up. Stretches that share enough pairs with an item are aligned with
the item's words (match 2, mismatch and gap -1), so edited and paraphrased copies score by what they share: score is the best
local alignment over twice the item's words. Documents with a score of at least MIN_SCORE are contaminated.

The filter loses no alignment of that score. Of an item's m words let an alignment match M, with E mismatches and gaps, and
2 M - E >= T, T being the score asked for times 2 m. The matches stand in at most E + 1 runs, so M - E - 1 >= T - m - 1
pairs of words are shared, and the aligned words of the document are at most 3 m - T. Where T - m - 1 is under 1 (items of up
to 10 words at MIN_SCORE), single words are looked up instead, of which T / 2 are shared. Nothing is shuffled.

Items of fewer than min_words words occur in prose by chance: they count where they are a document's whole text.

Defined results: null and empty texts hold nothing, and null and empty items are held nowhere; rows with a null id are searched like others; repeated rows give repeated results,
repeated items one result each; extra columns are ignored (find) or kept (remove); an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import _MULT, blocks, cut, lean, mix, table, word_hashes

MIN_WORDS, MIN_SCORE = 5, 0.55
BLOCK_CHARS = 4_000_000
MATCH, MISS, GAP = 2, -1, -1
_FILTER_BITS = 20
_POSTINGS, _CELLS = 1 << 20, 1 << 18


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram of words, and the place of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[:m] * _MULT[0]
    for i in range(1, n):
        total = total + (h[i : m + i] ^ (h[i : m + i] >> np.uint64(29))) * _MULT[i]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return total[at], at


class Lookup:
    """The n-grams (n words each) of some items, and which items hold each."""

    def __init__(self, n: int, of: np.ndarray, words: list[np.ndarray]):
        self.n = n
        grams = [np.unique(ngrams(words[k], np.zeros(len(words[k]), np.int64), n)[0]) for k in of]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(of, [len(g) for g in grams])
        order = np.argsort(gram, kind="stable")
        self.item = item[order]
        self.keys, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g that are n-grams of the items, and which key each is."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[g >> np.uint64(64 - _FILTER_BITS)])
        key = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[key] == g[at]
        return at[ok], key[ok]

    def postings(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, item) of all hits, sorted by item and word; a text's hits come together, those of few texts at a time."""
        g, where = ngrams(h, doc, self.n)
        at, key = self.hits(g)
        if not len(at):
            return
        n = self.count[key]
        edge = np.append(np.flatnonzero(np.diff(doc[where[at]], prepend=-1)), len(at))
        for b, e in blocks(np.add.reduceat(n, edge[:-1]).tolist(), _POSTINGS):
            part = slice(edge[b], edge[e])
            m = n[part]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item = self.item[np.repeat(self.first[key[part]], m) + inner]
            both = np.sort(item * len(h) + np.repeat(where[at[part]], m))
            yield both % len(h), both // len(h)


class Index:
    """Items of one block: words, n-grams, and how many of them a text must share within how many words."""

    def __init__(self, ids: list, texts: list[str], least: float = MIN_SCORE, min_words: int = MIN_WORDS):
        h, doc = word_hashes(texts)
        sizes = np.bincount(doc, minlength=len(texts))
        keep = np.flatnonzero(sizes)
        self.ids, self.least, self.min_words = [ids[i] for i in keep], least, min_words
        ends = np.cumsum(sizes)
        self.words = [h[ends[i] - sizes[i] : ends[i]] for i in keep]
        self.size = sizes[keep]
        score = np.ceil(MATCH * self.size * least - 1e-9).astype(np.int64)
        pairs = score - self.size - 1
        self.need = np.where(pairs >= 1, pairs, np.maximum(1, -(-score // MATCH)))
        self.span = np.maximum(self.size, 3 * self.size - score)
        sought = self.size >= min_words
        self.lookups = [Lookup(n, of, self.words) for n, of in ((1, np.flatnonzero(sought & (pairs < 1))), (2, np.flatnonzero(sought & (pairs >= 1)))) if len(of)]
        self.whole: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(~sought).tolist():
            self.whole.setdefault(tuple(self.words[k].tolist()), []).append(k)

    def stretches(self, h: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, first word, last word, shared n-grams): all places where an item can score as asked."""
        for lookup in self.lookups:
            for word, item in lookup.postings(h, doc):
                last = np.arange(len(word)) + self.need[item] - 1
                first = np.flatnonzero(last < len(word))
                last = last[first]
                k, d, span = item[first], doc[word[first]], self.span[item[first]]
                ok = (item[last] == k) & (doc[word[last]] == d) & (word[last] - word[first] <= span - lookup.n)
                if not ok.any():
                    continue
                first, last, k, d, span = first[ok], last[ok], k[ok], d[ok], span[ok]
                lo = np.maximum(starts[d], word[last] + lookup.n - span)
                hi = np.minimum(starts[d + 1], word[first] + span)
                new = np.ones(len(lo), bool)  # overlapping windows of a text and an item are one stretch
                new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (lo[1:] > hi[:-1])
                b = np.flatnonzero(new)
                e = np.append(b[1:], len(new)) - 1
                yield d[b], k[b], np.minimum.reduceat(lo, b), np.maximum.reduceat(hi, b), last[e] - first[b] + 1

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, score, shared n-grams, first word, last word) of the contaminated texts, the best place of each item."""
        h, doc = word_hashes(texts)
        starts = np.searchsorted(doc, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple] = {}
        if self.whole:
            sizes = np.diff(starts)
            for d in np.flatnonzero((sizes > 0) & (sizes < self.min_words)).tolist():
                for k in self.whole.get(tuple(h[starts[d] : starts[d + 1]].tolist()), ()):
                    best[d, k] = (1.0, int(sizes[d]), 0, int(sizes[d]))
        for d, k, lo, hi, shared in self.stretches(h, doc, starts):
            m, over = self.size[k], self.span[k]
            pieces = np.maximum(1, -(-(hi - lo - over) // (8 * m)))  # a long stretch in overlapping pieces
            rep = np.repeat(np.arange(len(k)), pieces)
            s = lo[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * 8 * m[rep]
            t = np.minimum(hi[rep], s + 8 * m[rep] + over[rep])
            scores = score_all(self.words, k[rep], h, s, t)
            for x in np.flatnonzero(scores >= self.least * MATCH * m[rep] - 1e-9).tolist():
                of, key = int(rep[x]), (int(d[rep[x]]), int(k[rep[x]]))
                value = float(scores[x]) / (MATCH * int(m[of]))
                if value > best.get(key, (0.0,))[0]:
                    _, i, j = align(self.words[key[1]], h[s[x] : t[x]])
                    begin = int(s[x]) - int(starts[key[0]])
                    best[key] = (value, int(shared[of]), begin + i, begin + j)
        return [(d, k, *v) for (d, k), v in sorted(best.items())]


def score_all(items: list[np.ndarray], item: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of items[item] with text[lo:hi], many at once: those of like sizes share a table."""
    size, width = np.array([len(items[k]) for k in item], np.int64), hi - lo
    out = np.zeros(len(item), np.int64)
    order = np.lexsort((width, size))
    at = 0
    while at < len(order):
        ahead = order[at : at + 4096]
        part = ahead[: max(1, _CELLS // max(1, int(width[ahead].max()), int(size[ahead].max())))]
        at += len(part)
        w, m = int(width[part].max()), int(size[part].max())
        cell = np.minimum(lo[part][:, None] + np.arange(w), len(text) - 1)
        inside = np.arange(w) < width[part][:, None]
        b = text[cell]
        a = np.zeros((len(part), m), np.uint64)
        for r, p in enumerate(part.tolist()):
            a[r, : size[p]] = items[item[p]]
        kind = np.int16 if MATCH * m + w < 30000 else np.int64
        slope = np.arange(w + 1, dtype=kind) * kind(-GAP)
        row, best = np.zeros((len(part), w + 1), kind), np.zeros(len(part), kind)
        for i in range(m):
            same = (b == a[:, i : i + 1]) & inside & (i < size[part])[:, None]
            up = np.maximum(row + kind(GAP), kind(0))
            np.maximum(up[:, 1:], row[:, :-1] + np.where(same, kind(MATCH), kind(MISS)), out=up[:, 1:])
            up += slope
            np.maximum.accumulate(up, axis=1, out=up)
            row = up - slope  # gaps along the row
            np.maximum(best, row.max(axis=1), out=best)
        out[part] = best
    return out


def _table(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score and the ends of it in a and b (exclusive)."""
    slope = np.arange(len(b) + 1) * -GAP
    row = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, x in enumerate(a):
        up = np.maximum(row + GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, MATCH, MISS))
        row = np.maximum.accumulate(up + slope) - slope  # gaps along the row
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best score, and first and last (exclusive) word of text in it."""
    score, i, j = _table(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = _table(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def build_indices(benchmark: DataFrame, least: float = MIN_SCORE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indices of all items, one a block of items and one at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = int(-(-chars // block_chars))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        ix = Index([r["item_id"] for r in rows], [r["text"] for r in rows], least, min_words)
        if ix.ids:
            yield ix


def _find(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for pdf in batches:
            texts, rows = pdf["text"].tolist(), []
            ids = pdf["doc_id"].astype("Int64")
            for b, e in blocks(len(t) if t else 0 for t in texts):
                rows += [(ids.iloc[b + d], ix.ids[k], score, seeds, i, j) for d, k, score, seeds, i, j in ix.search(texts[b:e])]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, end_word) for every contaminated row of docs(doc_id, text) and item."""
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, score double, n_seeds long, first_word long, end_word long"
    found: DataFrame | None = None
    held = None  # the index of the part that isn't checkpointed yet
    for ix in build_indices(benchmark, least, min_words, block_chars):
        if held is not None:
            found = cut(found)
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(ix)
        part = docs.mapInPandas(_find(held), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _clean(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.ones(len(texts), bool)
            for b, e in blocks(len(t) if t else 0 for t in texts):
                for found in index.value.search(texts[b:e]):
                    keep[b + found[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns. Of several blocks of items, each has a pass over what the one before left."""
    for i, ix in enumerate(build_indices(benchmark, least, min_words, block_chars)):
        docs = lean(cut(docs) if i else docs)
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(ix), docs.columns.index("text")), docs.schema)
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
