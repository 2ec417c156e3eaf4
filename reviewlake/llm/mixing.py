"""Mixing sources to target weights by Poisson replication (operator 2), with DataFrame functions only.

A source that holds n of N characters and shall hold the share w of the mix has the mean repetition rate w * N / n. Every
row draws its number of copies from a Poisson distribution with that mean, by inverting the distribution at a uniform
number hashed from seed and doc_id; so a rerun or a lost executor changes nothing. A mean above MEAN_STEP is drawn as the
sum of independent parts of at most MEAN_STEP. Rows are exploded by their counts and shuffled globally: dealt to
partitions by a hash key of id, text and copy, and sorted by it there, so that rows without an id or of a repeated one
spread as others do. The hot source only adds rows to a map-side sum.

Defined results: a null source is a source of its own; null and empty texts count 0 characters and follow their source's
rate; a source without characters has rate 1; a source that given weights lack has rate 0; rows with equal doc_id draw
alike, those with a null one by their text (rows equal in both share key and partition); extra columns pass through unless
named like the added ones, which replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import BROADCAST_ROWS, cut, free_name, small_side, table

MEAN_STEP = 16.0
#: Terms of the distribution function; beyond them the tail of a mean of 16 is under 1e-26.
TERMS = 81
ADDED = ("n_copies", "copy", "shuffle_key")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, budget: float | None = None) -> DataFrame:
    """(mix_source, rate) for every source: target weights as given, else in proportion to characters to the power exponent."""
    size = docs.groupBy(F.col("source").alias("mix_source")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("n"))
    if weights is None:
        weight = F.sqrt("n") if exponent == 0.5 else F.when(F.col("n") > 0, F.pow("n", F.lit(exponent))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(name), float(w)).otherwise(weight)
    size = cut(size.withColumn("w", F.when(F.col("n") > 0, weight).otherwise(0.0)))  # a row a source, read for sums, rates and their count
    total, weight_sum = size.agg(F.sum("n"), F.sum("w")).first()
    scale = (budget if budget is not None else total or 0.0) / (weight_sum or 1.0)
    return size.select("mix_source", F.when(F.col("n") > 0, F.lit(scale) * F.col("w") / F.col("n")).otherwise(1.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, budget: float | None = None, seed: int = 42, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, each row as often as drawn, with n_copies, copy (from 0) and shuffle_key, in global random order."""
    docs = docs.drop(*ADDED)
    rates = source_rates(docs, weights, exponent, budget)
    own, parts, cdf = (free_name(docs.columns, x) for x in ("mix_source", "mix_parts", "mix_cdf"))
    log_factorials = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(TERMS))
    rates = (
        rates.withColumn("mix_parts", F.expr(f"greatest(1L, cast(ceil(rate / {MEAN_STEP}D) as bigint))"))
        .withColumn("mix_mean", F.expr("rate / mix_parts"))
        .withColumn("mix_terms", F.expr(f"transform(array({log_factorials}), (f, k) -> case when mix_mean > 0 then exp(k * ln(mix_mean) - mix_mean - f) when k = 0 then 1D else 0D end)"))
        .withColumn("mix_cdf", F.expr(f"transform(sequence(1, {TERMS}), k -> aggregate(slice(mix_terms, 1, k), 0D, (a, t) -> a + t))"))
        .select(F.col("mix_source").alias(own), F.col("mix_parts").alias(parts), F.col("mix_cdf").alias(cdf))
    )
    id_text = "coalesce(cast(doc_id as string), concat('~', md5(coalesce(text, ''))))"
    uniform = f"cast(conv(substr(md5(concat('{seed}|', {id_text}, '|', cast(i as string))), 1, 13), 16, 10) as bigint) / 4503599627370496D"
    joined = docs.join(small_side(rates, rates.count(), broadcast_rows), F.col("source").eqNullSafe(F.col(own)))
    drawn = joined.withColumn("n_copies", F.expr(f"aggregate(transform(sequence(1L, {parts}), i -> {uniform}), 0L, (a, u) -> a + size(filter({cdf}, c -> c <= u)))"))
    drawn = drawn.drop(own, parts, cdf).filter("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.expr("sequence(0L, n_copies - 1)")))
    keyed = copies.withColumn("shuffle_key", F.expr(f"cast(conv(substr(md5(concat('{seed}#', {id_text}, '#', md5(coalesce(text, '')), '#', cast(copy as string))), 1, 15), 16, 10) as bigint)"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights in proportion to the square root of each source's characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "n_copies", "copy", "shuffle_key", "text")


QUERIES = {"op2_source_mixing": op2_source_mixing}
ORACLE_SQL = {
    "op2_source_mixing": """
WITH n AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN n > 0 THEN ((SELECT sum(n) FROM n) / (SELECT sum(sqrt(n)) FROM n)) * sqrt(n) / n ELSE 1.0 END AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::BIGINT AS parts FROM r),
t AS (SELECT source, parts, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS term FROM p, range(0, 81) AS g(k)),
c AS (SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
u AS (SELECT d.doc_id, d.source, d.text, i, ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, '~' || md5(coalesce(d.text, ''))) || '|' || i::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS i)),
m AS (SELECT u.doc_id, u.source, any_value(u.text) AS text, count(c.k) AS n_copies FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id, u.source)
SELECT doc_id, source, n_copies, copy, ('0x' || substr(md5('42#' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) || '#' || md5(coalesce(text, '')) || '#' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, text
FROM m, LATERAL (SELECT unnest(range(0, n_copies)) AS copy)"""
}
