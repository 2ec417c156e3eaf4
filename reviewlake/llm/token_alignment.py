"""Alignment of two tokenizers' tokens over the same bytes, by DuckDB on each Arrow partition (operator 11).

A text's tokens by A (a byte-level BPE, on a space and the text) and by B (pieces with byte fallback, which adds that space
itself) are intervals of the same bytes. Where tokens of both end, the text is cut: the tokens between two cuts are a group,
and the A and B token that end there are linked. Spark gives each task its rows as Arrow batches; there, in DuckDB, window sums
of token lengths make the interval tables, an equality join finds the cuts, ASOF joins give every token its group, and a range join
gives every cut its stretch of text. Partial counts of linked id pairs are merged by Spark.

Both tokenizers start anew at a single space between two characters that aren't white space (A's pattern starts a match there,
no piece of B crosses it: checked on the vocabularies, else texts aren't parted). So a text is a row of stretches between such
spaces, each distinct stretch is encoded and aligned once for the stretches of a round (ROUND_CHARS) and those that the task
still holds (HELD_STRETCHES and a round's new ones), and the groups of a text are those of its stretches in order. What rounds found is
checkpointed: distinct stretches with their links, and how often each document has them.

The pair counts (vocabulary sizes bound their number, not the corpus) go back to the rounds as sorted arrays, at most
PAIRS_AT_ONCE of them in a pass, all pairs of a B id in the same pass; larger tables take more passes over the checkpoint,
whose sums add up. Texts longer than ROUND_CHARS take several rounds of one task; they are checked as a whole before the first.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens (zeros, an
empty digest, no links counted); repeated rows and rows with null ids each give a row and count; ties for the highest
count all are best; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, lean, table

#: Default vocabularies; parameters. The files must be readable on every executor.
VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ROUND_CHARS, HELD_STRETCHES, PAIRS_AT_ONCE = 8_000_000, 400_000, 2_000_000
#: Stretches that are encoded as one text.
RUN = 50_000
#: The space of B's pieces, and its byte pieces (fixed values).
MARK, BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
_PART = re.compile(r"(?<=\S) (?=\S)")
#: White space but the space and the line end.
_WHITE = re.compile(r"[^\S \n]")

_ALIGN = """
CREATE OR REPLACE TEMP TABLE a AS SELECT pos, id, sum(len) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM a_in;
CREATE OR REPLACE TEMP TABLE b AS SELECT pos, id, sum(len) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM b_in;
CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.stop, a.id AS a, b.id AS b, sum(1) OVER (ORDER BY a.stop ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM a JOIN b ON a.stop = b.stop;
"""
_LINKS = "SELECT s.stretch, c.a, c.b FROM cuts c JOIN stretch_in s ON c.stop > s.start AND c.stop <= s.stop ORDER BY c.stop"
_GROUPS = """
SELECT grp, side, id FROM (
  SELECT c.grp, 0 AS side, t.pos, t.id FROM a t ASOF JOIN cuts c ON t.stop <= c.stop UNION ALL
  SELECT c.grp, 1 AS side, t.pos, t.id FROM b t ASOF JOIN cuts c ON t.stop <= c.stop) ORDER BY grp, side, pos
"""


class Tokenizer:
    """Ids and byte lengths of both tokenizers' tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level entries write the other bytes from 256 on
        code = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(sorted({*range(256)} - {*chars}))}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.written = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self.len_a, self.len_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        level = json.loads(self.a.to_str())
        start = level.get("pre_tokenizer") or {}
        self.parts = start.get("type") == "ByteLevel" and bool(start.get("use_regex")) and not start.get("add_prefix_space") and not level.get("normalizer") and not any(MARK in p.lstrip(MARK) for p in pieces)

    def stretches(self, text: str) -> list[str]:
        """The text's stretches, which begin with the space before them; text is not empty."""
        if not self.parts:
            return [text]
        parts = text.split(" ")
        return _PART.split(text) if "" in parts or "\n " in text or " \n" in text or _WHITE.search(text) else parts

    def _ids_a(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _encode_a(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each behind a space, and how many each has; size is in bytes with that space."""
        row = " ".join(texts)
        if self.parts and not row[0].isspace() and not row[-1].isspace() and self.stretches(row) == texts:  # as one text
            ids = self._ids_a(" " + row)
            ends = np.searchsorted(np.cumsum(self.len_a[ids]), np.cumsum(size), side="left") + 1
            return ids, np.diff(ends, prepend=0)
        if len(texts) == 1:
            ids = self._ids_a(" " + row)
            return ids, np.array([len(ids)])
        odd = [not t or t[0].isspace() or t[-1].isspace() or not self.parts for t in texts]
        edge = [0, *sorted({k for k, x in enumerate(odd) if x} | {k + 1 for k, x in enumerate(odd) if x}), len(texts)]
        done = [self._encode_a(texts[i:j], size[i:j]) for i, j in zip(edge, edge[1:]) if i < j]
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and their number a text, B's likewise, which texts both give back byte for byte, and bytes with the space before."""
        whole = (" " + " ".join(texts)).encode()
        size = np.fromiter(map(len, map(str.encode, texts)), np.int64, len(texts)) + 1
        a, n_a = self._encode_a(texts, size)
        per = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, per), np.int64, len(per))
        b = np.fromiter(chain.from_iterable(per), np.int64, int(n_b.sum()))

        def same(ids: np.ndarray, n: np.ndarray, names: list[bytes], lengths: np.ndarray) -> np.ndarray:
            good = np.add.reduceat(np.append(lengths[ids], 0), np.cumsum(n) - n) * (n > 0) == size
            if good.all() and b"".join(map(names.__getitem__, ids.tolist())) == whole:
                return good
            ends = np.cumsum(n)
            return np.array([b"".join(names[i] for i in ids[e - k : e].tolist()) == (" " + t).encode() for t, e, k in zip(texts, ends, n)], bool)

        return a, n_a, b, n_b, same(a, n_a, self.bytes_a, self.len_a) & same(b, n_b, self.bytes_b, self.len_b), size


@lru_cache(2)
def tokenizer(path_a: str, path_b: str) -> Tokenizer:
    """Loaded once a process."""
    return Tokenizer(path_a, path_b)


class _Places(dict):
    """Numbers of stretches; new ones get the next."""

    def __init__(self, held: list[str]):
        super().__init__(zip(held, range(len(held))))
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = place = len(self)
        self.new.append(stretch)
        return place


class Aligner:
    """The stretches that a task holds, aligned in DuckDB: by number their groups as text, counts and links."""

    def __init__(self, both: Tokenizer, most: int = HELD_STRETCHES):
        self.both, self.most = both, most
        self.con = duckdb.connect(config={"threads": 1})
        self.place = _Places([])
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # of A, of B, groups, occurrences; zeros if a tokenizer doesn't give the stretch back
        self.links = np.zeros((0, 2), np.int32)

    def shrink(self) -> None:
        """Forgets the stretches that were met once, or all if that isn't enough."""
        keep = np.flatnonzero(self.counts[:, 3] > 1)
        keep = keep if len(keep) <= self.most // 2 else keep[:0]
        names = list(self.place)
        self.links = self.links_of(keep)[1]
        self.place = _Places([names[i] for i in keep.tolist()])
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.counts = self.counts[keep]

    def learn(self, texts: list[str]) -> None:
        """Aligns the new stretches."""
        counts, links = [self.counts], [self.links]
        for at in range(0, len(texts), RUN):
            run = texts[at : at + RUN]
            a, n_a, b, n_b, good, size = self.both.encode(run)
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            size = size[good]
            stop = np.cumsum(size)
            self.con.register("a_in", pa.table({"pos": np.arange(len(a)), "id": a, "len": self.both.len_a[a]}))
            self.con.register("b_in", pa.table({"pos": np.arange(len(b)), "id": b, "len": self.both.len_b[b]}))
            self.con.register("stretch_in", pa.table({"stretch": np.flatnonzero(good), "start": stop - size, "stop": stop}))
            self.con.execute(_ALIGN)
            link = self.con.sql(_LINKS).fetchnumpy()
            n_groups = np.bincount(link["stretch"].astype(np.int64), minlength=len(run))
            token = self.con.sql(_GROUPS).fetchnumpy()
            grp, side, ids = token["grp"], token["side"], token["id"]
            group_end = np.append(grp[1:] != grp[:-1], [True] * min(1, len(grp)))
            after = np.where(group_end, 2, np.append(side[1:] != side[:-1], [False] * min(1, len(grp))))
            written = list(map(self.both.written.__getitem__, (3 * ids + after).tolist()))
            ends = np.flatnonzero(group_end)[np.cumsum(n_groups)[n_groups > 0] - 1] + 1  # of the stretches that have groups
            text = iter(["".join(written[i:j])[:-1] for i, j in zip(np.append([0], ends[:-1]).tolist(), ends.tolist())])
            self.groups += [next(text) if n else "" for n in n_groups.tolist()]
            counts.append(np.stack([n_a * good, n_b * good, n_groups, np.zeros(len(run), np.int64)], 1))
            links.append(np.stack([link["a"], link["b"]], 1).astype(np.int32))
        self.counts, self.links = np.concatenate(counts), np.concatenate(links)

    def codes(self, stretches: list[str]) -> np.ndarray:
        """Numbers of stretches, new ones aligned; earlier numbers may change."""
        if len(self.place) > self.most:
            self.shrink()
        code = np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches))
        if self.place.new:
            self.learn(self.place.new)
            self.place.new = []
        self.counts[:, 3] += np.bincount(code, minlength=len(self.counts))
        return code

    def links_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each of the codes has, and the (a, b) ids of all."""
        n, stop = self.counts[codes, 2], np.cumsum(self.counts[:, 2])[codes]
        at = np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())
        return n, self.links[at]


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pieces(text: str, chars: int) -> Iterator[str]:
    """The text in pieces of chars or a little more, cut at single spaces that part stretches."""
    at = 0
    while at < len(text):
        m = _PART.search(text, at + chars) if len(text) - at > chars else None
        yield text[at : m.start() if m else len(text)]
        at = m.end() if m else len(text)


ROUND = "docs binary, doc_ids binary, null_ids binary, counts binary, digests binary, groups array<string>, links binary, a binary, b binary, of_doc binary, of_stretch binary, times binary"


def _rounds(path_a: str, path_b: str, chars: int, keep_groups: bool):
    """A row for each round: its documents with their counts, and its stretches' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizer(path_a, path_b)
        align = Aligner(both)
        held: list[tuple[int, int | None, str, bool, bool]] = []  # row, doc_id, piece, whether it is the text's first, last
        digest = hashlib.sha256()
        sums = np.zeros(3, np.int64)
        said: list[str] = []

        def whole(text: str) -> bool:
            """Whether a text of several pieces is given back byte for byte."""
            for p in pieces(text, chars):
                code = align.codes(both.stretches(p))
                if not align.counts[code, 2].all():
                    return False
            return True

        def round_() -> pa.RecordBatch:
            nonlocal digest, sums, said
            stretches: list[str] = []
            n = np.zeros(len(held), np.int64)
            for k, (_, _, text, _, _) in enumerate(held):
                if text:
                    part = both.stretches(text)
                    n[k] = len(part)
                    stretches += part
            code = align.codes(stretches)
            ends = np.cumsum(n)
            piece = np.repeat(np.arange(len(held)), n)
            fine = np.ones(len(held), bool)
            fine[piece[align.counts[code, 2] == 0]] = False
            counts = np.stack([np.bincount(piece, align.counts[code, k], len(held)) for k in range(3)], 1).astype(np.int64) * fine[:, None]
            rows, ids, totals, digests, groups = [], [], [], [], []
            for k, (row, doc_id, _, first, last) in enumerate(held):
                if first:
                    digest, sums, said = hashlib.sha256(), np.zeros(3, np.int64), []
                if counts[k, 2]:
                    text = ";".join(map(align.groups.__getitem__, code[ends[k] - n[k] : ends[k]].tolist()))
                    digest.update((";" + text if sums[2] else text).encode())
                    sums = sums + counts[k]
                    if keep_groups:
                        said.append(text)
                rows.append(row)
                ids.append(doc_id)
                totals.append(sums if last else np.zeros(3, np.int64))
                digests.append(digest.digest() if last and sums[2] else bytes(32))
                groups.append(";".join(said) if last and keep_groups else None)
            code, piece = code[fine[piece]], piece[fine[piece]]
            used, stretch = np.unique(code, return_inverse=True)
            n_links, links = align.links_of(used)
            key, times = np.unique(piece * max(1, len(used)) + stretch, return_counts=True)
            out = [_packed(np.array(rows, np.int64)), _packed(np.array([i or 0 for i in ids], np.int64)), _packed(np.array([i is None for i in ids], bool)), _packed(np.array(totals, np.int64)), b"".join(digests), groups]
            out += [_packed(x.astype(np.int32)) for x in (n_links, links[:, 0], links[:, 1], key // max(1, len(used)), key % max(1, len(used)), times)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.list_(pa.string())) for x in out], [c.split()[0] for c in ROUND.split(", ")])

        size = 0
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                parts = list(pieces(text, chars)) if text else [""]
                if len(parts) > 1 and not whole(text):
                    parts = [""]
                for k, part in enumerate(parts):
                    held.append((row, doc_id, part, k == 0, k == len(parts) - 1))
                    size += len(part) + 64
                    if size >= chars:
                        yield round_()
                        size = 0
        if held:
            yield round_()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): links of a task's rounds by id pair."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            links = _unpacked(row["links"], np.int32)
            times = np.bincount(_unpacked(row["of_stretch"], np.int32), _unpacked(row["times"], np.int32), len(links)).astype(np.int64)
            key = (_unpacked(row["a"], np.int32).astype(np.int64) << 32) | _unpacked(row["b"], np.int32)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.repeat(times, links)]), len(keys)).astype(np.int64)
            if len(keys) > PAIRS_AT_ONCE:
                yield out()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys):
        yield out()


def _scores(key: np.ndarray, n: np.ndarray, best: np.ndarray, first: bool):
    """A row for each document of each round: its part of the result, over the pairs given (sorted). Counts come with the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, links = _unpacked(row["docs"], np.int64), _unpacked(row["links"], np.int32)
                pair = (_unpacked(row["a"], np.int32).astype(np.int64) << 32) | _unpacked(row["b"], np.int32)
                at = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
                hit = key[at] == pair if len(key) else np.zeros(len(pair), bool)
                stretch = np.repeat(np.arange(len(links)), links)
                doc, of, times = (_unpacked(row[c], np.int32) for c in ("of_doc", "of_stretch", "times"))
                part = []
                for value in (best, n):
                    each = np.zeros(len(links), np.int64)
                    np.add.at(each, stretch[hit], value[at[hit]])
                    total = np.zeros(len(docs), np.int64)
                    np.add.at(total, doc, each[of] * times)
                    part.append(total)
                counts = _unpacked(row["counts"], np.int64).reshape(-1, 3) * int(first)
                digests = [row["digests"][i : i + 32].hex() if first and any(row["digests"][i : i + 32]) else "" for i in range(0, len(row["digests"]), 32)]
                ids = pa.array(_unpacked(row["doc_ids"], np.int64), mask=_unpacked(row["null_ids"], bool))
                yield pa.RecordBatch.from_arrays([pa.array(docs), ids, *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(3)), *map(pa.array, part), pa.array(digests, pa.string())], [c.split()[0] for c in SCORE.split(", ")])

    return run


SCORE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string"


def aligned_rounds(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, chars: int = ROUND_CHARS, keep_groups: bool = False) -> DataFrame:
    """The checkpointed rounds over docs(doc_id, text)."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(lean(docs).mapInArrow(_rounds(path_a, path_b, chars, keep_groups), ROUND))


def pair_counts(rounds: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each id pair."""
    return rounds.select("links", "a", "b", "of_stretch", "times").mapInArrow(_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def aligned_groups(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """(doc_id, place, a_ids, b_ids): every group of every text, in order."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = pa.array(_unpacked(row["doc_ids"], np.int64), mask=_unpacked(row["null_ids"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["groups"], pa.string())], ["doc_id", "groups"])

    of = aligned_rounds(docs, path_a, path_b, keep_groups=True).select("doc_ids", "null_ids", "groups").mapInArrow(texts, "doc_id long, groups string").filter("groups != ''")
    each = of.select("doc_id", F.posexplode(F.split("groups", ";")).alias("place", "of"))
    return each.select("doc_id", "place", *(F.split(F.split("of", r"\|")[k], ",").cast("array<int>").alias(name) for k, name in enumerate(("a_ids", "b_ids"))))


def align_tokens(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, chars: int = ROUND_CHARS, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs(doc_id, text)."""
    rounds = aligned_rounds(docs, path_a, path_b, chars)
    pairs = cut(pair_counts(rounds))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    passes = max(1, -(-pairs.count() // pairs_at_once))
    found: DataFrame | None = None
    for k in range(passes):
        some = pairs.join(top, "b").filter(F.pmod(F.xxhash64("b"), F.lit(passes)) == k)
        got = some.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n", (F.col("n") == F.col("top")).cast("long").alias("best")).toArrow()
        key, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(key)
        part = rounds.drop("groups").mapInArrow(_scores(key[order], n[order], best[order], k == 0), SCORE)
        part = cut(part) if passes > 1 else part
        found = part if found is None else found.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")]
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.sum("n_groups").alias("n_links"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return align_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
