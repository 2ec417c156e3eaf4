"""Toxicity by compression distance (operator 4).

Fitting takes a bounded sample of labelled texts (SAMPLE_TEXTS a class, the smallest by hash, SAMPLE_CHARS in all). Two
thirds of it train two zstandard dictionaries, the rest calibrates. The ordinary dictionary is trained on windows of
ordinary texts. Of toxic texts a lexical selection comes first: their words with 5-character strings that stand RATIO times as
often in toxic as in ordinary texts, and in MIN_PLACES places and MIN_SHARE times the toxic texts' number at least. The toxic
dictionary is trained on those words; it is laid over the ordinary dictionary's content, so that what both know costs the
same in both. (Trained on the toxic windows themselves, whole, chosen by compression or without the words of ordinary texts,
it holds ordinary text for the most part and tells few documents: see the README.) So documents that are toxic only by words
rarer than that, or by the order of ordinary words, are missed. A window's distance is its compressed length with the ordinary
dictionary less that with the toxic one. Thresholds are calibrated: a logistic model turns how many of a text's windows reach
each of THRESHOLDS, and what share, into a score.

The constants were chosen by cross-validation inside the rows that the contract lets teach (README); held-out rows had no
part in it.

Every text is scored whole, in windows of WINDOW_WORDS words; nothing is shuffled but the sample.

Defined results: null, empty and all-white texts have no windows and get the score of no evidence; rows with a null id are
scored and never learned from; a doc_id labelled more than once is toxic if any label says so; without both classes in the
labels every score is 0; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import blocks, bucket_of, lean, smallest_by_hash, table, words

SAMPLE_TEXTS, SAMPLE_CHARS = 3000, 24_000_000
WINDOW_WORDS, DICTIONARY_BYTES, LEVEL = 8, 16_384, 3
#: A 5-character string is evidence if it stands in MIN_PLACES places of toxic texts and MIN_SHARE times their number, and so many times as often there.
MIN_PLACES, MIN_SHARE, RATIO = 4, 0.02, 8.0
SPAN = 5
#: Distances in bytes that windows are held against; the calibration weighs how many windows reach each.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 11)


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Text index, first byte and last byte of each window of WINDOW_WORDS words, and the bytes."""
    h, doc, first, last, data, _ = words([t.lower() if t else t for t in texts])
    if not len(h):
        return doc, first, last, data
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
    at = np.flatnonzero(place % WINDOW_WORDS == 0)
    end = np.append(at[1:], len(doc)) - 1
    return doc[at], first[at], last[end], data


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + 2 * len(THRESHOLDS)))
    fitted: bool = False

    def distances(self, first: np.ndarray, last: np.ndarray, data: bytes) -> np.ndarray:
        if not hasattr(self, "_coders"):
            known = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.ordinary, self.toxic)]
            for k in known:
                k.precompute_compress(level=LEVEL)
            self._coders = [zstandard.ZstdCompressor(dict_data=k, write_checksum=False, write_content_size=False, write_dict_id=False) for k in known]
        where = np.stack([first, last - first], axis=1).astype(np.uint64).tobytes()
        source = zstandard.BufferWithSegments(data, where)
        a, b = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(source)), np.int64, len(first)) for c in self._coders)
        return a - b

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: 1, log of its windows; for each threshold the log of the windows that reach it, and their share."""
        out = np.zeros((len(texts), 2 + 2 * len(THRESHOLDS)))
        out[:, 0] = 1
        for b, e in blocks(len(t) if t else 0 for t in texts):
            doc, first, last, data = windows(texts[b:e])
            if not len(doc):
                continue
            gap = self.distances(first, last, data)
            n = np.bincount(doc, minlength=e - b)
            out[b:e, 1] = np.log1p(n)
            for i, limit in enumerate(THRESHOLDS):
                over = np.bincount(doc, weights=gap >= limit, minlength=e - b)
                out[b:e, 2 + 2 * i], out[b:e, 3 + 2 * i] = np.log1p(over), over / np.maximum(n, 1)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -40, 40)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_coders"}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of few samples, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def _strings(texts: list[str]) -> tuple[Counter, int]:
    """In how many different places (words before) each string stands, so that copies of a text count once; and all places."""
    found: Counter = Counter()
    places = {(a, b) for t in texts for w in [t.lower().split()] for a, b in zip(["", *w], w)}
    for _, w in places:
        w = f" {w} "
        found.update({w[i : i + SPAN] for i in range(len(w) - SPAN + 1)})
    return found, len(places)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of toxic and ordinary texts (bounded lists)."""
    if not toxic or not ordinary:
        return Model()
    parts = [(ts[: max(1, 2 * len(ts) // 3)], ts[max(1, 2 * len(ts) // 3) :] or ts) for ts in (toxic, ordinary)]
    (tox_fit, tox_cal), (ord_fit, ord_cal) = parts
    (in_tox, of_tox), (in_ord, of_ord) = _strings(tox_fit), _strings(ord_fit)
    least = max(min(MIN_PLACES, max(1, len(tox_fit) // 4)), MIN_SHARE * len(tox_fit))
    evidence = {s for s, n in in_tox.items() if n >= least and n / of_tox >= RATIO * (in_ord[s] + 1) / of_ord}

    def cut_windows(texts: list[str]) -> list[bytes]:
        _, first, last, data = windows(texts)
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist())]

    marked = []
    for t in tox_fit:  # words that begin with evidence, or consist of it by half
        for w in t.lower().split():
            padded = f" {w} "
            held = [padded[i : i + SPAN] in evidence for i in range(len(padded) - SPAN + 1)]
            if held and (held[0] or 2 * sum(held) >= len(held)):
                marked.append(padded.encode("utf-8", "surrogatepass"))
    base = _dictionary(cut_windows(ord_fit), DICTIONARY_BYTES)
    # the most frequent words with evidence last, where matches are cheapest
    common = [w for w, _ in Counter(marked).most_common(DICTIONARY_BYTES // 16)]
    own = _dictionary([b"".join(marked[i : i + 8]) for i in range(0, len(marked), 8)], DICTIONARY_BYTES // 2) + b"".join(reversed(common))
    model = Model(base, base + own[-DICTIONARY_BYTES:], fitted=True)
    labels = np.array([1.0] * len(tox_cal) + [0.0] * len(ord_cal))
    texts = tox_cal + ord_cal
    model.weights = _logistic(model.features(texts), labels)
    return model


def fit_model(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, toxic). The driver gets at most texts rows a class and chars characters.

    A text of over a 16th of its class's characters is learnt from by a stretch of that many, at a place drawn by hash, so that no
    single text takes the place of others."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    chosen = smallest_by_hash(marks, "toxic", sizes, texts)
    # at most 2 * texts ids
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    share, length = max(1, chars // 32), F.length("text")
    stretch = F.col("text").substr((F.pmod(F.xxhash64("doc_id"), F.greatest(length - share + 1, F.lit(1))) + 1).cast("int"), F.lit(share))
    sample = sample.withColumn("text", F.when(length > share, F.regexp_replace(stretch, r"^\S*\s+|\s+\S*$", "")).otherwise(F.col("text")))
    sample = sample.withColumn("before", F.sum(F.length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = sample.filter(F.col("before") <= chars // 2).select("toxic", "place", "text").orderBy("place").collect()
    return fit_texts([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def _scores(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.value.score(pdf["text"].tolist())})

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scores(shared), "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns outside the held-out part (crc32 of the id, modulo 3, is 1)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_model(docs, labels.filter(bucket_of("doc_id", 3) != 1))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
