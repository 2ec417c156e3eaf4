"""Connected components of an edge table, without collecting links on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import cut

#: Distinct edges up to which one task solves the rest (16 bytes an edge).
LOCAL_EDGES = 2_000


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that isn't the smallest; vectorised min-label with pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    node, comp = star_forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
    return pd.DataFrame({"node": node, "comp": comp})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:  # each batch to a star forest: the same components by at most as many edges
        a, b = star_forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": a, "b": b})


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step of the alternating algorithm."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = large.filter("a != b")
    # after the large star every edge points down: a > b
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, comp) for every node of edges(a, b) that isn't the smallest of its component; comp is the smallest.

    Few distinct edges are solved in one task; more go through large-star and small-star rounds, each checkpointed, until
    nothing changes. No edges: no rows. Loops (a = b) and null ends are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b")
    edges = cut(edges.mapInPandas(_contract, "a long, b long").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= local_edges:
            return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_solve, "node long, comp long")
        if before == tuple(now):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before, edges = tuple(now), cut(_round(edges))
