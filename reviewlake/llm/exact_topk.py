"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 5).

Vectors become integers floor(256 * x); a term is a dimension, a posting a row's non-zero component. Rows are packed into
blocks of candidates and blocks of queries; a task gets one block of each. There, for every term, the query rows scatter
their weight times the term's postings into dense score arrays; a partition selection takes each query's k best, and the
best of all candidate blocks are merged. Work is queries times rows by nature; no task holds more than two blocks, and a
query sends on k rows a candidate block. A row travels once for every QUERY_BLOCK queries, in integers as small as its
block allows.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id;
an empty vector scores 0 with all; missing components of shorter vectors count 0; of rows with equal ids and different
vectors the smallest vector stands; ties go to the smaller id; extra columns are ignored. Components and scores beyond 64-bit
integers are set to the nearest one (sums that could pass them are taken exactly first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import table

QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 8192
PAIR = "qb long, cb long, side int, ids binary, dims int, width int, body binary"


def _pack(side: int, others: int, size: int):
    """Blocks of rows, each repeated for every block of the other side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, part in pdf.groupby("block", sort=False):
                for s in range(0, len(part), size):
                    rows = part.iloc[s : s + size]
                    vecs = [np.asarray(v, np.int64) for v in rows["terms"]]
                    dims = max((len(v) for v in vecs), default=0)
                    body = np.zeros((len(vecs), dims), np.int64)
                    for i, v in enumerate(vecs):
                        body[i, : len(v)] = v
                    most = max(int(body.max(initial=0)), -1 - int(body.min(initial=0)))
                    body = body.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max))
                    ids, packed = rows["vec_id"].to_numpy(np.int64).tobytes(), body.tobytes()
                    for j in range(others):  # one copy at a time
                        q, c = (block, j) if side == 0 else (j, block)
                        yield pd.DataFrame([(q, c, side, ids, dims, body.itemsize, packed)], columns=["qb", "cb", "side", "ids", "dims", "width", "body"])

    return run


def _load(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of the packed rows of one side, in order of id."""
    dims = int(pdf["dims"].max())
    ids, mats = [], []
    for i, d, w, b in zip(pdf["ids"], pdf["dims"], pdf["width"], pdf["body"]):
        one = np.frombuffer(i, np.int64)
        mat = np.zeros((len(one), dims), np.int64)
        mat[:, :d] = np.frombuffer(b, f"i{w}").reshape(len(one), d)
        ids.append(one)
        mats.append(mat)
    at = np.concatenate(ids)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(mats)[order]


def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates (query id, id, score) by term-at-a-time accumulation; c_ids ascend."""
    dims = min(q.shape[1], c.shape[1])
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (q, c)]
    bound = dims * most[0] * most[1]  # of any score
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    q, c = q.astype(kind), c.astype(kind)
    postings = []
    for t in range(dims):
        at = np.flatnonzero(c[:, t])
        at = slice(None) if 2 * len(at) >= len(c) else at  # a term that most rows hold is read whole
        postings.append((at, np.ascontiguousarray(c[at, t])))
    out_q, out_c, out_s = [], [], []
    scores, part = np.zeros(len(c), kind), np.zeros(len(c), kind)  # of one query: small enough to stay in a core's cache
    for i, weights in enumerate(q):
        scores[:] = 0
        for t in np.flatnonzero(weights[:dims]):
            at, values = postings[t]
            if isinstance(at, slice):
                np.multiply(values, weights[t], out=part)
                scores += part
            else:
                scores[at] += values * weights[t]
        row = (np.clip(scores, -(2**63), 2**63 - 1) if kind is object else scores).astype(np.int64)
        own = q_ids[i]
        others = np.flatnonzero(c_ids != own)
        if len(others) > k:
            low = np.partition(row[others], len(others) - k)[len(others) - k]
            others = others[row[others] >= low]
            others = others[np.argsort(~row[others], kind="stable")[:k]]  # ids ascend: ties to the smaller
        out_q.append(np.full(len(others), own))
        out_c.append(c_ids[others])
        out_s.append(row[others])
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == i] for i in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c, s = best_of(*_load(sides[0]), *_load(sides[1]), k)
        return pd.DataFrame({"query_id": q, "vec_id": c, "score": s})

    return run


def exact_topk(vectors: DataFrame, k: int = 5, query_modulus: int = 50, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row of vectors(vec_id, embedding) whose id query_modulus divides."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    rows = rows.select("vec_id", F.expr("transform(v, x -> cast(floor(x * 256) as bigint))").alias("terms"))
    rows = rows.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_modulus == 0, 1))).first()
    q_blocks, c_blocks = max(1, -(-m // query_block)), max(1, -(-n // candidate_block))

    def dealt(df: DataFrame, count: int, salt: int) -> DataFrame:
        df = df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)))
        return df.repartition(count, "block")

    queries = dealt(rows.filter(F.col("vec_id") % query_modulus == 0), q_blocks, 1).mapInPandas(_pack(0, c_blocks, query_block), PAIR)
    candidates = dealt(rows, c_blocks, 2).mapInPandas(_pack(1, q_blocks, candidate_block), PAIR)
    found = queries.union(candidates).groupBy("qb", "cb").applyInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth embedding against all."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_exact_topk": op5_exact_topk}
ORACLE_SQL = {
    "op5_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
