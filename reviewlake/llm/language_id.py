"""Language identification by language-bitmask n-gram filters (operator 1).

Fitting takes a bounded sample of labelled texts a language (SAMPLE_TEXTS, the smallest by hash; the labels counted are
those outside the held-out part), counts the character n-grams of each language, and keeps each language's GRAMS most
frequent ones, weighted against the other languages so that marks of one language come first. The n-grams go into one
bit-sliced Bloom filter: SLOTS slots of one bit a language. Setting an n-gram sets the language's bit in HASHES slots;
a look-up ANDs the masks of an n-gram's slots and returns all languages that (seem to) contain it. A mask has as many 64-bit
words as the languages need.

A whole text is judged by its n-grams' masks: each language's bit is counted (per-language popcount), the false positives
expected from that language's filled slots are subtracted, and the language with the highest corrected count wins; score is
the share of the text's n-grams that it accounts for. Very long texts are read in pieces that end where a word ends, so
they need no more memory and lose no n-gram.

The filter's size (2 MB for every 64 languages) and the sample depend on the number of languages, not on the corpus.

Defined results: null text or no letter: `und` and score 0; ties go to the more frequent language, then the smaller name;
no labelled rows: `und`; a text whose n-grams no filter knows gets the most frequent language with score 0; rows with a
null id are judged and never learned from; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import bucket_of, cut, lean, mix, smallest_by_hash, table

SAMPLE_TEXTS, GRAMS, SLOTS, HASHES = 1500, 6000, 1 << 18, 3
#: Characters that are read at once; longer texts are read in pieces.
PIECE = 1 << 19
WIDTHS = (2, 3, 4)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of one or more texts: letters in lower case, words padded by one space, none across words."""
    code = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter()[code], code, np.uint32(32)).astype(np.uint64)
    letter = code != 32
    for w in WIDTHS:
        m = len(code) - w + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[w - 1 :] if w == 2 else np.logical_and.reduce([letter[i : m + i] for i in range(1, w - 1)])
        total = np.full(m, np.uint64(w))
        for i in range(w):
            total = total * np.uint64(0x100000001B3) + code[i : m + i]
        yield mix(total), ok


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of a text of PIECE characters and the rest of the word there."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield begin, end
        begin = end


@dataclass
class Filter:
    """A fitted filter: languages by frequency of their labels, masks of the slots (a row for every 64 languages), false-positive rates."""

    languages: list[str]
    slot_count: int = SLOTS
    masks: np.ndarray = field(init=False)
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.masks = np.zeros((-(-len(self.languages) // 64), self.slot_count), np.uint64)

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        bits = self.slot_count.bit_length() - 1
        return [((h >> np.uint64(bits * i)) & np.uint64(self.slot_count - 1)).astype(np.int64) for i in range(HASHES)]

    def add(self, language: int, h: np.ndarray) -> None:
        for s in self.slots(h):
            self.masks[language // 64, s] |= np.uint64(1 << language % 64)

    def close(self) -> "Filter":
        fill = [np.count_nonzero(self.masks[i // 64] & np.uint64(1 << i % 64)) / self.slot_count for i in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES
        return self

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The masks of n-grams: a row for every 64 languages."""
        first, *rest = self.slots(h)
        found = self.masks[:, first]
        for s in rest:
            found &= self.masks[:, s]
        return found

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        hits, total = np.zeros((len(self.languages), n)), np.zeros(n)
        k = 0
        while k < n:  # whole short texts together, long ones in pieces
            group, size = [], 0
            while k < n and (not group or size + len(texts[k] or "") <= PIECE):
                if texts[k]:
                    group.append(k)
                    size += len(texts[k])
                k += 1
            parts = [(i, texts[i][s:e]) for i in group for s, e in pieces(texts[i])]
            runs = [parts] if size <= PIECE else [[p] for p in parts]
            for run in runs:
                if not run:
                    continue
                lowered = [p[1].lower() for p in run]
                begin = np.cumsum([1] + [len(x) + 1 for x in lowered])
                for h, ok in grams(" ".join(lowered)):
                    at = np.flatnonzero(ok)
                    mask = self.lookup(h[at])
                    owner = np.clip(np.searchsorted(begin, at + 1, side="right") - 1, 0, len(run) - 1)
                    total += np.bincount(np.array([p[0] for p in run])[owner], minlength=n)
                    for i in range(len(self.languages)):
                        hit = (mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
                        hits[i] += np.bincount(np.array([p[0] for p in run])[owner[hit]], minlength=n)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        rate = self.false_rate[:, None]
        true = np.maximum(0.0, (hits - total * rate) / np.maximum(1e-9, 1 - rate))
        best = true.argmax(axis=0)  # ties: the first, as languages are in order of frequency and name
        score = np.where(total > 0, np.clip(true[best, np.arange(n)] / np.maximum(total, 1), 0, 1), 0.0)
        known = [bool(t) and any(c.isalpha() for c in t) for t in texts]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, score, 0.0)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            parts = [np.unique(h[ok], return_counts=True) for t in part["text"] for s, e in pieces(t) for h, ok in grams(t[s:e])]
            if parts:
                h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
                yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n.astype(np.int64)})


def fit_filter(labelled: DataFrame, texts: int = SAMPLE_TEXTS, keep: int = GRAMS) -> Filter:
    """The filter of labelled(doc_id, text, lang). Reads at most texts rows a language; the driver gets at most keep n-grams a language."""
    labelled = labelled.filter("text is not null and lang is not null and doc_id is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Filter([]).close()
    chosen = smallest_by_hash(labelled, "lang", {r["lang"]: r["count"] for r in sizes}, texts).select("doc_id", "lang")
    # at most texts ids a language
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    counts = cut(sample.mapInPandas(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))  # of the bounded sample
    whole = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    rate = counts.join(F.broadcast(whole), "lang").withColumn("rate", F.col("n") / F.col("whole"))
    other = counts.join(F.broadcast(whole), "lang").groupBy("gram").agg(F.max(F.col("n") / F.col("whole")).alias("most"))
    # frequent where the language uses it about as often as any other does
    weighed = rate.join(other, "gram").filter("n >= 2 and rate >= 0.5 * most")
    best = Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")
    rows = weighed.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep).select("lang", "gram").toPandas()
    out = Filter(languages)
    for i, lang in enumerate(languages):
        out.add(i, rows.loc[rows["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64))
    return out.close()


def _judge(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = model.value.judge(pdf["text"].tolist())
            yield pdf.drop(columns="text").assign(lang_pred=lang, score=score)

    return run


def predict_language(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_judge(shared), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Filter, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a known language with a score of at least least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.judge(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return lean(docs).mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns outside the held-out part (crc32 of the id, modulo 4, is 2)."""
    docs = table(spark, sf_dir, "documents")
    model = fit_filter(docs.filter(bucket_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = predict_language(docs, model)
    return found.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
