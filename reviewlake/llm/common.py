"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a counted table of a few numbers a row is broadcast (a few MB).
BROADCAST_ROWS = 100_000
#: Bits of the largest filter of ids (16 MB).
FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where none is, a temporary one is set in local mode (and
    removed at exit); on a cluster, whose executors don't see it, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="reviewlake-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df, after its session's Arrow batches are bounded in rows and bytes, so that a Python worker holds few texts at once. The
    settings hold when the query runs, so they stay; row bounds that are smaller already are kept."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int | None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose row count was measured; other sides are shuffled, adaptively split if skewed."""
    return F.broadcast(df) if rows is not None and rows <= bound else df


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Four places in a Bloom filter of each id."""
    h = mix(ids.astype(np.int64).view(np.uint64))
    step = mix(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(ids: DataFrame, n: int, most_bits: int = FILTER_BITS) -> Callable[[str], Column]:
    """A test of a column's ids that fails only for ids that ids, n rows of one column, lacks. Rows of large texts that fail it need no
    shuffle to be told apart; those that pass go through a join. Null ids fail.

    It is a Bloom filter of at least 16 bits an id (some 0.3 % pass by chance) up to most_bits, from where on more pass."""
    bits = min(most_bits, 1 << max(16, (16 * n - 1).bit_length()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_places(pdf["id"].to_numpy(), bits))
            yield pd.DataFrame({"piece": at >> 16, "at": at & 0xFFFF})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 16, bool)
        held[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    named = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).filter("id is not null")
    pieces = named.mapInPandas(place, "piece long, at long").groupBy("piece").applyInPandas(pack, "piece long, bits binary")
    whole = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for piece, part in pieces.collect():  # the filter, 16 MB at most
        whole[piece] = np.frombuffer(part, np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(whole.ravel())

    @F.pandas_udf("boolean")
    def passes(held: pd.Series) -> pd.Series:
        at = _places(held.to_numpy(), bits)
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

    return lambda column: F.col(column).isNotNull() & passes(F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")))


def with_ids(df: DataFrame, column: str, side: DataFrame, n: int, bound: int, how: str = "inner") -> DataFrame:
    """df joined to the n rows of side, whose first column holds its ids: how is inner, left_semi or left_anti. Up to bound rows of side
    are broadcast; beyond, only those rows of df are shuffled that a filter of the ids lets pass."""
    on = F.col(column) == F.col(side.columns[0])
    if n <= bound:
        return df.join(F.broadcast(side), on, how)
    passes = may_hold(side.select(side.columns[0]), n)(column)
    near = df.filter(passes).join(side, on, how)
    return df.filter(~passes).unionByName(near) if how == "left_anti" else near


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the split that contracts fix."""
    return F.crc32(F.col(column).cast("string")) % modulus


def smallest_by_hash(ids: DataFrame, group: str, counts: dict, n: int) -> DataFrame:
    """(doc_id, group, place) of the n different ids of each group with the smallest hashes, place from 1 in that order.

    counts holds the rows of each group; other groups are left out. Hashes beyond the share of the range in which 4 * n + 64
    rows are expected are dropped before anything is shuffled, so a task gets that many rows of a group, however large it is.
    A group that consists mostly of rows of a few ids may give fewer than n."""
    h = F.xxhash64("doc_id")
    within = F.lit(False)
    for g, count in counts.items():
        share = min(1.0, (4 * n + 64) / max(1, count))
        within |= (F.col(group) == F.lit(g)) & (h <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64))))
    few = ids.filter(within).select("doc_id", group).distinct()
    return few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(h, "doc_id"))).filter(F.col("place") <= n)


# --- words of texts, as 64-bit hashes, on numpy arrays ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, _BASE_INV))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def word_runs(data: bytes, gaps: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, first and last bytes (exclusive) of the runs of bytes outside gaps, A-Z in lower case, in pieces of 1 MB or one run."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not gaps[data[end]]:  # a piece ends where a word ends
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~gaps[raw], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            up, down = _power_table(max(_PIECE + 4096, len(raw) + 1))
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[_LOWER[raw]] * up[: len(raw)])])
            yield mix((total[last] - total[first]) * down[first]), first + at, last + at
        at = end


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts' UTF-8 joined by newlines, and where each begins."""
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return b"\n".join(coded), np.cumsum([0] + [len(c) + 1 for c in coded[:-1]]) if coded else np.zeros(0, np.int64)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of the words [^ \\t-\\r]+ of all texts, A-Z in lower case: hashes, text indices, and first and last byte (exclusive) in
    the texts' UTF-8 joined by newlines; those bytes; and where each text begins in them. Works in pieces of 1 MB."""
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join(coded)
    begins = np.cumsum([0] + [len(c) + 1 for c in coded[:-1]]) if coded else np.zeros(0, np.int64)
    hashes, places, ends, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:  # a piece ends where a word ends
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_SPACE[raw], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            up, down = _power_table(max(_PIECE + 4096, len(raw) + 1))
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[_LOWER[raw]] * up[: len(raw)])])
            hashes.append(mix((total[last] - total[first]) * down[first]))
            places.append(first + at)
            ends.append(last + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, data, begins
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(begins, place, side="right") - 1, place, np.concatenate(ends), data, begins


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and each word's text index; see words()."""
    return words(texts)[:2]


def blocks(sizes: Iterable[int], limit: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most limit in all, one item at least."""
    begin, total, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, k
            begin, total = k, 0
        total += n
    if k >= begin:
        yield begin, k + 1


_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, as hashes sorted within each text, and their text index. A text of fewer words gives one shingle of all of them."""
    h, doc = word_hashes(texts)
    if not len(h):
        return h, doc
    out, where = [], []
    n = np.bincount(doc, minlength=len(texts))
    for width in range(1, k + 1):  # texts with fewer than k words: their whole sequence, marked by its length
        pick = n == width if width < k else n >= k
        if not pick.any() or len(h) < width:
            continue
        m = len(h) - width + 1
        ok = (doc[:m] == doc[width - 1 :]) & pick[doc[:m]]
        total = np.full(m, np.uint64(width * int(_MULT[7]) % 2**64))
        for i in range(width):
            total += mix(h[i : i + m] + np.uint64(i)) * _MULT[i % 7]
        out.append(mix(total[ok]))
        where.append(doc[:m][ok])
    h, doc = np.concatenate(out), np.concatenate(where)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]
