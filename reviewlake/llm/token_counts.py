"""Token counts by an exact length histogram (operator 3).

Texts are encoded by a public byte-level BPE; documents aggregate by encoded length. Suffix sums over the histogram answer,
for every context limit L at once: how many documents have at least L tokens, total tokens, quantiles, and the total when
every document is truncated to L. Lengths between two rows of the histogram follow from the longer one's row.

Suffix sums are taken inside blocks of lengths, then shifted by the sums of the blocks above; a block holds at most
BLOCK lengths and there is one small row a block, so no task gets the whole histogram of a large corpus.

Runs of LONG_SPACE or more white-space characters, which the pattern's look-ahead can't take in one go, are cut where the
pattern cuts them and encoded as the single pieces that they are, so texts of any length give their exact count.

Defined results: null and empty texts have 0 tokens; very long texts and runs of white space count in full; strings of special tokens in a text are ordinary text; repeated rows
and rows with null ids count; extra columns are ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, lean, table

#: Default vocabulary; a parameter. The file must be readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that goes with the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 256
LONG_SPACE = 4096
#: White space as the pattern's \s understands it (Unicode White_Space; fixed values).
_SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
_encoders: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The encoding of a ranks file, loaded once a process."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def count_tokens(text: str | None, path: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Tokens of a whole text. A run of white space is a piece of its own up to its last character, which goes with what follows
    (PATTERN); other patterns must cut white space alike."""
    if not text:
        return 0
    coder, total, at = encoder(path, pattern), 0, 0
    for m in _SPACE_RUN.finditer(text) if len(text) >= LONG_SPACE else ():
        end = m.end() - (m.end() < len(text))
        total += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(coder.encode_ordinary(text[at:] if at else text))


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # counted a batch at a time: what leaves is a histogram
            n, docs = np.unique(np.array([count_tokens(t, path, pattern) for t in pdf["text"]], np.int64), return_counts=True)
            yield pd.DataFrame({"n_tokens": n, "docs": docs.astype(np.int64)})

    return run


def length_histogram(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many rows of docs(text) have each encoded length."""
    counted = lean(docs).select(F.col("text").cast("string").alias("text")).mapInPandas(_lengths(path, pattern), "n_tokens long, docs long")
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with, for each length L in it: docs_ge and tokens_ge (documents of at least L tokens and their tokens),
    truncated_total (tokens if every document is cut to L), total_docs, total_tokens, and quantile (share of documents of at most L)."""
    own = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # one row a block of lengths: a few even for the longest texts
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("of_block"), (F.sum("d").over(above) - F.col("d")).alias("d_above"), (F.sum("t").over(above) - F.col("t")).alias("t_above"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = own.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
    rows = rows.join(blocks, F.col("block") == F.col("of_block"))
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over) for any limits, from suffix_sums(). Work is limits times lengths: for lists of limits, not for a limit a row."""
    given = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the shortest length above the limit holds all that lie above it
    after = F.broadcast(given).join(sums, F.col("n_tokens") > F.col("context_limit"), "left")
    least = after.groupBy("context_limit").agg(F.max("docs_ge").alias("docs_over"), F.max("tokens_ge").alias("over"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total")).first()[0]
    docs_over, over = F.coalesce("docs_over", F.lit(0)), F.coalesce("over", F.lit(0))
    return least.select("context_limit", (F.lit(total) - over + F.col("context_limit") * docs_over).alias("truncated_total"), docs_over.alias("docs_over"))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the shortest length that the share of documents doesn't exceed. For lists of shares, as truncated_totals."""
    given = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(given).join(sums, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op3_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return suffix_sums(cut(length_histogram(table(spark, sf_dir, "documents"))))


QUERIES = {"op3_token_length_histogram": op3_token_length_histogram}
ORACLE_SQL: dict[str, str] = {}
