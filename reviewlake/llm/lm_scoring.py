"""Language-model scoring by deleted interpolation (operator 12).

A token is a word, A-Z in lower case, or the end of a text. Its probability mixes maximum-likelihood estimates from longer to shorter
contexts: p = x3 c(uvw)/c(uv) + (1 - x3) (x2 c(vw)/c(v) + (1 - x2) (x1 c(w)/N + (1 - x1) / (V + 1))). The weight x3 depends on
the bucket (power of two) of c(uv), x2 on that of c(v); a context that was never met has weight 0. The learning rows are
parted: a share of them (one in DELETED / 10 of these) is deleted from the counts that the weights are learned with, and
expectation-maximisation fits the weights to those rows' tokens; scores then take the counts of all learning rows.

Counting, as Spark jobs over blocks of texts (BLOCK_BYTES, packed and checkpointed once): each task sorts a block's n-grams
and sends, for every part of the hash range, the block's distinct n-grams with their counts, as gaps of sorted hashes. A
task of the second stage holds one part, adds up the counts, and answers each block in the block's own order, so that an answer
is a few bits an n-gram. Texts and answers meet by block. No n-gram is a row, a frequent one is sent once a block, and the
number of parts follows the corpus (PART_NGRAMS). Expectation-maximisation reads the deleted rows' counts, checkpointed, once
an iteration; two sums a bucket come back.

Reach: a block sends a row to each part, so parts that hold PART_NGRAMS are worth it up to some terabytes of text; beyond that
BLOCK_BYTES must grow with the square root of the corpus (and the workers' memory with it).

Words are told apart by 64-bit hashes; of pairs and triples as many bits are kept as make two of them equal once in 2^24.

Defined results: null and empty texts are one token, the end; rows with a null id are never learned from and are held out; repeated
rows count and are scored as often as they stand; without learning rows every token has probability 1 and the base score is
that of N = V = 0; without deleted rows the weights are 1/2. Texts longer than a block are cut where a word ends, with the two words before
carried on. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, joined, lean, mix, table, word_runs

#: crc32(doc_id) modulo HELD_OUT is 0 for rows that aren't learned from; modulo DELETED it is 1 for the deleted ones.
HELD_OUT, DELETED = 10, 40
BLOCK_BYTES, PART_NGRAMS = 8_000_000, 2_000_000
ROUNDS, PRECISION = 30, 1e-5
BUCKETS = 64
LEARNED, LEFT_OUT, SCORED = 0, 1, 2
_START, _END = (mix(np.array([k], np.uint64))[0] for k in (0x51A27, 0xE2D))
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACE = re.compile("[ \t-\r]")


def _packed(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed."""
    a = np.ascontiguousarray(a).astype(np.uint64)
    planes = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.uint64).reshape(-1)


def _floats(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.float32)


# --- blocks of texts --------------------------------------------------------------------------------------------------

PACK = "kind int, rows binary, doc_ids binary, null_ids binary, first binary, last binary, before binary, begins binary, texts binary, size long"


def _pieces(text: str, size: int) -> Iterator[tuple[str, bool, bool, list]]:
    """(piece, first, last, hashes of the two tokens before) of a text; pieces end where a word ends."""
    at, before = 0, [_START, _START]
    while True:
        m = _SPACE.search(text, at + size) if len(text) - at > size else None
        piece = text[at : m.start() if m else len(text)]
        yield piece, at == 0, m is None, before
        if m is None:
            return
        for h, _, _ in word_runs(piece.encode("utf-8", "surrogatepass")):
            before = [*before, *h[-2:]][-2:]
        at = m.start()


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {LEARNED: [], LEFT_OUT: [], SCORED: []}
        sizes = dict.fromkeys(held, 0)

        def block(kind: int) -> pa.RecordBatch:
            rows, ids, texts, first, last, before = zip(*held[kind])
            data, begins = joined(list(texts))
            row = [kind, _packed(np.array(rows, np.uint64)), _packed(np.array([i or 0 for i in ids], np.int64).view(np.uint64)), bytes(i is None for i in ids), bytes(first), bytes(last), np.array(before, np.uint64).tobytes(), _packed(begins), zstandard.ZstdCompressor(level=3).compress(data), len(data)]
            kinds = [pa.int32(), *[pa.binary()] * 8, pa.int64()]
            held[kind], sizes[kind] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in PACK.split(", ")])

        for batch in batches:
            for row, doc_id, text, kind in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text", "kind"))):
                for piece, first, last, before in _pieces(text or "", size):
                    held[kind].append((row, doc_id, piece, first, last, before))
                    sizes[kind] += len(piece) + 64
                    if sizes[kind] >= size:
                        yield block(kind)
        for kind in held:
            if held[kind]:
                yield block(kind)

    return run


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and sums of weights."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.append([True], ranked[1:] != ranked[:-1])[: len(keys)]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new) - 1
    return ranked[new], of, np.bincount(of, weights, int(new.sum())).astype(np.uint64)


class Block:
    """A block's tokens: those of each piece are led by the two before it. words, grams: sorted distinct keys; *_n: how often they
    are learned from; *_of: where the key of a place is among them (pairs and triples are both grams)."""

    def __init__(self, row: dict, bits: int):
        first, last = (np.frombuffer(row[c], bool) for c in ("first", "last"))
        before = np.frombuffer(row["before"], np.uint64).reshape(-1, 2)
        begins = _unpacked(row["begins"]).astype(np.int64)
        parts = list(word_runs(zstandard.ZstdDecompressor().decompress(row["texts"])))
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _, _ in parts)])
        of = np.searchsorted(begins, np.concatenate([np.zeros(0, np.int64), *(x for _, x, _ in parts)]), side="right") - 1
        self.rows, self.ids, self.null_ids = _unpacked(row["rows"]).astype(np.int64), _unpacked(row["doc_ids"]).view(np.int64), np.frombuffer(row["null_ids"], bool)
        n_words = np.bincount(of, minlength=len(begins))
        self.n = n_words + last
        lead = np.cumsum(self.n + 2) - (self.n + 2)
        seq = np.empty(int((self.n + 2).sum()), np.uint64)
        seq[lead], seq[lead + 1] = before[:, 0], before[:, 1]
        seq[lead[of] + 2 + np.arange(len(h)) - (np.cumsum(n_words) - n_words)[of]] = h
        seq[(lead + 2 + n_words)[last]] = _END
        here = np.ones(len(seq), bool)
        here[lead] = False
        self.place = np.cumsum(here) - 1
        token = here.copy()
        token[lead + 1] = False
        self.at = np.flatnonzero(token)
        weight = token.astype(np.uint8)
        weight[lead + 1] = first
        weight *= row["kind"] != SCORED
        pairs = mix(seq[:-1] * _M[0] + seq[1:] * _M[1])[here[1:]]
        triples = mix(seq[self.at - 2] * _M[2] + mix(seq[self.at - 1] * _M[0] + seq[self.at] * _M[1]))
        self.words, self.word_of, self.word_n = _distinct(seq[here], weight[here])
        self.grams, of, self.gram_n = _distinct(np.concatenate([pairs, triples]) >> np.uint64(64 - bits), np.concatenate([weight[here], weight[self.at]]))
        self.pair_of, self.triple_of = of[: len(pairs)], of[len(pairs) :]

    def estimates(self, word_n: np.ndarray, gram_n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each token c(uvw), c(uv), c(vw), c(v), c(w), from the counts of the block's words and grams."""
        here, before = self.place[self.at], self.place[self.at - 1]
        return gram_n[self.triple_of], gram_n[self.pair_of[before]], gram_n[self.pair_of[here]], word_n[self.word_of[before]], word_n[self.word_of[here]]


# --- counts -----------------------------------------------------------------------------------------------------------

SENT = "part int, block long, kind int, words binary, word_n binary, grams binary, gram_n binary"
ANSWER = "block long, part int, kind int, word_all binary, gram_all binary, word_kept binary, gram_kept binary, tokens long, words_known long, tokens_kept long, words_kept long"


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields)], [c for c, _ in fields])


def _send(bits: int, part_bits: int):
    """The n-grams of each block by part of the hash range, as gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, bits)
                ends = [np.searchsorted(keys >> np.uint64(width - part_bits), np.arange(2**part_bits + 1, dtype=np.uint64)) for keys, width in ((b.words, 64), (b.grams, bits))]
                out: list[tuple] = []
                for part in range(2**part_bits):
                    cells: list[bytes] = []
                    for keys, n, end, width in ((b.words, b.word_n, ends[0], 64), (b.grams, b.gram_n, ends[1], bits)):
                        lo, hi = end[part], end[part + 1]
                        cells += [_packed(np.diff(keys[lo:hi], prepend=np.uint64(part << (width - part_bits)))), _packed(n[lo:hi])]
                    if any(end[part] < end[part + 1] for end in ends):
                        out.append((part, row["block"], row["kind"], *cells))
                    if len(out) == 64:
                        yield _batch(SENT, [*zip(*out)])
                        out = []
                if out:
                    yield _batch(SENT, [*zip(*out)])

    return run


def _sum(bits: int, part_bits: int):
    """Answers to the blocks, one part at a time; rows come sorted by part. The first answer of a part carries its totals."""

    def answers(held: list[dict]) -> Iterator[pa.RecordBatch]:
        part, kinds = held[0]["part"], np.array([r["kind"] for r in held])
        cells, totals = [], []
        for names, n_names, width in (("words", "word_n", 64), ("grams", "gram_n", bits)):
            base = np.uint64(part << (width - part_bits))
            keys = [np.cumsum(_unpacked(r[names])) + base for r in held]
            sizes = [len(k) for k in keys]
            kind = np.repeat(kinds, sizes)
            count = np.concatenate([_unpacked(r[n_names]) for r in held])
            found, of, _ = _distinct(np.concatenate(keys), np.zeros(len(kind), np.uint8))
            both = np.bincount(of, count, len(found)).astype(np.uint64)
            kept = np.bincount(of, count * (kind == LEARNED), len(found)).astype(np.uint64)
            stop = np.cumsum(sizes)
            cells.append([(both[of[e - n : e]], kept[of[e - n : e]]) for n, e in zip(sizes, stop)])
            if names == "words":
                true = found != _START
                totals = [int(both[true].sum()), int((both[true] > 0).sum()), int(kept[true].sum()), int((kept[true] > 0).sum())]
        out = []
        for i, r in enumerate(held):
            left_out = r["kind"] == LEFT_OUT
            (word_all, word_kept), (gram_all, gram_kept) = cells[0][i], cells[1][i]
            out.append((r["block"], part, r["kind"], _packed(word_all), _packed(gram_all), _packed(word_kept) if left_out else None, _packed(gram_kept) if left_out else None, *(totals if i == 0 else [0] * 4)))
            if len(out) == 64:
                yield _batch(ANSWER, [*zip(*out)])
                out = []
        if out:
            yield _batch(ANSWER, [*zip(*out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != held[0]["part"]:
                    yield from answers(held)
                    held = []
                held.append(row)
        if held:
            yield from answers(held)

    return run


def _met(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks, each followed by its answers in order."""
    texts = packs.withColumn("part", F.lit(-1))
    return texts.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part")


def _answered(batches: Iterator[pa.RecordBatch], bits: int, of: str) -> Iterator[tuple[Block, tuple[np.ndarray, ...]]]:
    """Blocks with their estimates."""
    block: Block | None = None
    words: list[np.ndarray] = []
    grams: list[np.ndarray] = []

    def whole() -> tuple[Block, tuple[np.ndarray, ...]]:
        return block, block.estimates(np.concatenate(words), np.concatenate(grams))

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                if block is not None:
                    yield whole()
                block, words, grams = Block(row, bits), [], []
            else:
                words.append(_unpacked(row[f"word_{of}"]))
                grams.append(_unpacked(row[f"gram_{of}"]))
    if block is not None:
        yield whole()


# --- weights ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights by bucket of the context's count, the last bucket being that of unknown contexts; tokens and distinct tokens learned."""

    three: tuple[float, ...]
    two: tuple[float, ...]
    one: float
    tokens: int
    words: int


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _bucket(n: np.ndarray) -> np.ndarray:
    """Power of two of a context's count; BUCKETS - 1 for none."""
    return np.where(n > 0, np.minimum(np.frexp(n.astype(np.float64))[1] - 1, BUCKETS - 2), BUCKETS - 1)


def _terms(model: Model, f3: np.ndarray, b3: np.ndarray, f2: np.ndarray, b2: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four summands of each token's probability."""
    x3, x2 = np.array(model.three)[b3], np.array(model.two)[b2]
    rest = (1 - x3) * (1 - x2)
    return x3 * f3, (1 - x3) * x2 * f2, rest * (model.one * f1), rest * ((1 - model.one) / (model.words + 1))


def _left_out(bits: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for _, (c3, n3, c2, n2, c1) in _answered(batches, bits, "kept"):
            for at in range(0, max(1, len(c1)), 1 << 20):
                s = slice(at, at + (1 << 20))
                cells = [_ratio(c3[s], n3[s]), _bucket(n3[s]), _ratio(c2[s], n2[s]), _bucket(n2[s]), c1[s] / max(1, tokens)]
                yield _batch("f3 binary, b3 binary, f2 binary, b2 binary, f1 binary", [[press(x.astype(np.float32 if x.dtype == np.float64 else np.uint8).tobytes())] for x in cells])

    return run


def _expect(model: Model):
    """(key, a, b) sums of a task: a weight's next value is a / b. Keys: BUCKETS for x3, BUCKETS for x2, x1, and log-likelihood and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(2 * BUCKETS + 2), np.zeros(2 * BUCKETS + 2)
        for batch in batches:
            for row in batch.to_pylist():
                f3, f2, f1 = (_floats(row[c]).astype(np.float64) for c in ("f3", "f2", "f1"))
                b3, b2 = (np.frombuffer(zstandard.ZstdDecompressor().decompress(row[c]), np.uint8) for c in ("b3", "b2"))
                q3, q2, q1, q0 = _terms(model, f3, b3, f2, b2, f1)
                p = q3 + q2 + q1 + q0
                for k, of, some, all_ in ((0, b3, q3, p), (BUCKETS, b2, q2, p - q3)):
                    a[k : k + BUCKETS] += np.bincount(of, some / p, BUCKETS)
                    b[k : k + BUCKETS] += np.bincount(of, all_ / p, BUCKETS)
                a[2 * BUCKETS] += (q1 / p).sum()
                b[2 * BUCKETS] += ((q1 + q0) / p).sum()
                a[2 * BUCKETS + 1] += np.log(p).sum()
                b[2 * BUCKETS + 1] += len(p)
        key = np.flatnonzero(b)
        yield _batch("key int, a double, b double", [key, a[key], b[key]])

    return run


def fit_weights(left_out: DataFrame, tokens: int, words: int, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the left-out rows' tokens, until a round gains less than PRECISION of a nat a token."""
    half = (*[0.5] * (BUCKETS - 1), 0.0)
    model, before = Model(half, half, 0.5, tokens, words), -math.inf
    for _ in range(rounds):
        sums = {r.key: (r.a, r.b) for r in left_out.mapInArrow(_expect(model), "key int, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
        if 2 * BUCKETS + 1 not in sums:
            break
        # one imagined token for and against each weight keeps all of them inside (0, 1)
        x = [round((sums[k][0] + 1) / (sums[k][1] + 2), 9) if k in sums else 0.5 for k in range(2 * BUCKETS + 1)]
        model = Model((*x[: BUCKETS - 1], 0.0), (*x[BUCKETS : 2 * BUCKETS - 1], 0.0), x[2 * BUCKETS], tokens, words)
        now = sums[2 * BUCKETS + 1][0] / sums[2 * BUCKETS + 1][1]
        if now - before < PRECISION:
            break
        before = now
    return model


# --- scores -----------------------------------------------------------------------------------------------------------

SCORE = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (c3, n3, c2, n2, c1) in _answered(batches, bits, "all"):
            piece = np.repeat(np.arange(len(block.n)), block.n)
            p = sum(_terms(model, _ratio(c3, n3), _bucket(n3), _ratio(c2, n2), _bucket(n2), c1 / max(1, model.tokens)))
            base = np.log10((c1 + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            sums = [np.bincount(piece, w, len(block.n)) for w in (c1 > 0, base, np.log10(p))]
            ids = [None if null else i for i, null in zip(block.ids.tolist(), block.null_ids.tolist())]
            yield _batch(SCORE, [block.rows, ids, block.n.astype(np.int64), sums[0].astype(np.int64), sums[1], sums[2]])

    return run


def fit_and_score(docs: DataFrame, size: int = BLOCK_BYTES, part_ngrams: int = PART_NGRAMS, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """Every row of docs(doc_id, text) scored, and the model: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    kind = F.when(F.coalesce(crc % HELD_OUT, F.lit(0)) == 0, SCORED).when(crc % DELETED == 1, LEFT_OUT).otherwise(LEARNED).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", kind.alias("kind"))
    packs = cut(lean(docs).mapInArrow(_pack(size), PACK).withColumn("block", F.monotonically_increasing_id()))
    total = packs.agg(F.sum("size")).first()[0] or 0
    tokens = total // 5 + 1
    part_bits = max(1, math.ceil(math.log2(1 + 2 * tokens / part_ngrams)))
    bits = min(64, max(part_bits + 1, math.ceil(math.log2(2 * tokens)) + 24))
    sent = packs.mapInArrow(_send(bits, part_bits), SENT).repartition(2**part_bits, "part").sortWithinPartitions("part")
    answers = cut(sent.mapInArrow(_sum(bits, part_bits), ANSWER))
    n, v, n_kept, v_kept = (int(x or 0) for x in answers.agg(*(F.sum(c) for c in ("tokens", "words_known", "tokens_kept", "words_kept"))).first())
    answers = answers.drop("tokens", "words_known", "tokens_kept", "words_kept")
    mine = _met(packs.filter(F.col("kind") == LEFT_OUT), answers.filter(F.col("kind") == LEFT_OUT))
    fitted = fit_weights(cut(mine.mapInArrow(_left_out(bits, n_kept), "f3 binary, b3 binary, f2 binary, b2 binary, f1 binary")), n_kept, v_kept, rounds)
    model = Model(fitted.three, fitted.two, fitted.one if n else 0.0, n, v)
    rows = _met(packs, answers.drop("word_kept", "gram_kept")).mapInArrow(_score(model, bits), SCORE)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums)
    held_out = (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT, F.lit(0)) == 0).alias("held_out")
    return whole.select("doc_id", held_out, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"), model


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return fit_and_score(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op12_lm_scoring": op12_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
