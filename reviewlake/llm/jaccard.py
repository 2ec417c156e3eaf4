"""N-gram Jaccard self-join by a token-group matrix (operator 7).

Every text becomes its set of distinct k-word shingles; two texts link when 100 * |intersection| >= percent * |union|. The
join is exact (but for collisions of two 63-bit digests at once, or of 64-bit shingle hashes) and emits no pairs within copies:

1. Texts with equal sets are one class, known by a 63-bit digest of the set; only classes go on. Digests that different sets
   share (told by a second digest; about one pair in 2^64, so at 10^10 sets a handful) are replaced by the second one.
2. Classes are partitioned into families that hold every possible link. Two sets that link differ in at most H(size)
   tokens. Tokens are dealt by hash to more than H parts, so some untouched part is equal in both (of larger sets: to more
   than H/2 parts of three thirds, so some part has two equal thirds, which are rarer to agree by chance); classes that
   share a signature join the same family. Sizes fall into levels so narrow that linked sets are in the same or adjacent
   levels, and every set signs for its own level and the one below, as two nodes, so that families don't grow together across
   levels; a family without a set of its own level is left out, as those pairs meet one level up. A set with so many empty parts that the untouched one
   may be empty signs again with other deals. Every map task sends one entry a signature; the other holders become local
   edges. So no signature, however common, piles up. Buckets of signatures hold neighbouring levels, each level as many as
   its tokens need, so that the signatures that two sets share meet in few buckets and few edges tell the same.
3. In each family sets are sorted into groups of similar sets; each group has its token union. A query set opens only the
   groups whose union overlaps it enough, and compares with members that its component lacks. Families above a bound grow
   faster than the table, by chains of sets of which most link with nothing. There a set goes on only if enough of its tokens are
   in other sets of the family too; tokens are dealt by ranges of their hashes to count that. What is still above the bound is
   cut into blocks. A set stays in its own block, and goes on to those others whose token union (a bitmap, which only ever adds
   tokens) it overlaps enough; what two blocks exchanged in this way is one task.
4. Components of the links give every row the smallest doc_id.

Defined results: null, empty and all-white texts have 0 shingles and link with nothing; rows with a null doc_id link with
nothing and have a null component; repeated rows are copies; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reviewlake.llm.common import blocks, cut, free_name, lean, mix, shingle_sets, small_side, table, with_ids
from reviewlake.llm.components import LOCAL_EDGES, components, star_forest

#: Signatures gathered in a map task before they are combined and sent.
FLUSH = 500_000
#: Signatures meant for one reduce group.
BUCKET_SIGNATURES = 1_000_000
#: Sets and tokens of one block of a family, on average; bits of a block's token union; blocks whose unions a task holds at once.
BLOCK_SETS, BLOCK_TOKENS = 2048, 1_000_000
UNION_BITS, UNIONS = 23, 32
#: Tokens of large families gathered in a map task before they are dealt.
DEALT_TOKENS = 2_000_000
#: Sets of one group of the token-group matrix.
GROUP_SETS = 16
#: Differences from which on parts have three thirds.
WIDE = 16
#: Deals of tokens to parts, after which a set with too many empty parts signs for its level as a whole.
DEALS = 4


def max_difference(a: int, percent: int) -> int:
    """Most tokens in which a set of a tokens may differ from a linked one that isn't smaller."""
    return (a + 100 * a // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def levels(percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each level up to size, and the largest difference of pairs whose smaller set is in it."""
    first = [1]
    while first[-1] <= size:
        first.append(100 * first[-1] // percent + 1)
    return np.array(first), np.array([max_difference(b - 1, percent) for b in first[1:]] + [0])


def digest_pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 63-bit digests (as even int64s) of each set; 0 for an empty one. h is in order of the sets."""
    out = np.zeros((2, len(n)), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            s1, s2 = np.add.reduceat(mix(h + np.uint64(k)), at), np.add.reduceat(mix(h ^ np.uint64(salt)), at)
            out[k, full] = mix(s1 + mix(s2 + n[full].astype(np.uint64)))
    first, second = out.view(np.int64) & ~np.int64(1)
    return first, second


def set_digests(h: np.ndarray, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The digest that names each set: the first, or the second if different sets share the first (a sorted array)."""
    first, second = digest_pairs(h, n)
    if not len(shared):
        return first
    return np.where(shared[np.minimum(np.searchsorted(shared, first), len(shared) - 1)] == first, second, first)


def signatures(h: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text index, 1 if for the level below) so that any two different linked sets share a signature."""
    first, most = levels(percent, int(n.max(initial=1)))
    level = np.searchsorted(first, n, side="right") - 1
    out_s, out_d, out_l = [], [], []
    for down in (0, 1):
        scheme = level - down
        use = (n > 0) & (scheme >= 0)
        use[use] &= most[scheme[use]] > 0  # no difference allowed: linked sets are equal
        if down:  # only sets that can have a partner in the level below
            use[use] &= -(-percent * n[use] // 100) < first[level[use]]
        for deal in range(DEALS + 1):
            docs = np.flatnonzero(use)
            if not len(docs):
                break
            t = scheme[docs]
            if deal == DEALS:
                out_s.append(mix(mix(t.astype(np.uint64) + np.uint64(1 << 40))))
                out_d.append(docs)
                out_l.append(np.full(len(docs), down))
                break
            # sets with room for it: parts of three thirds, few enough differences that one part has at most one, and so two
            # equal thirds; other sets: parts few enough that one has none. Spare parts make up for empty ones.
            wide = most[t] >= WIDE
            spare = np.where(wide, 2 + most[t] // 32, 2 + most[t] // 16)
            parts = np.where(wide, most[t] // 2, most[t]) + 1 + spare
            cells = np.where(wide, 3 * parts, parts)
            begin = np.zeros(len(n), np.int64)
            begin[docs] = np.cumsum(cells) - cells
            count = np.zeros(len(n), np.int64)
            count[docs] = cells
            mine = use[doc]
            hh, dd = h[mine], doc[mine]
            dealt = mix(hh ^ np.uint64(0xABCD0001 + deal))
            gid = begin[dd] + ((dealt >> np.uint64(20)) % count[dd].astype(np.uint64)).astype(np.int64)
            total = int(cells.sum())
            cnt = np.bincount(gid, minlength=total)
            low = np.bincount(gid, weights=(dealt & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
            high = np.bincount(gid, weights=(dealt >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
            owner = np.repeat(np.arange(len(docs)), cells)
            cell = np.arange(total) - begin[docs][owner]
            mate = np.where(wide[owner], np.arange(total) - cell % 3 + (cell + 1) % 3, np.arange(total))  # the next third of the part
            twin = mate != np.arange(total)
            key = (t[owner] * DEALS + deal).astype(np.uint64) * np.uint64(1 << 32) + cell.astype(np.uint64)
            cnt = cnt + np.where(twin, cnt[mate], 0)
            both_low, both_high = low + np.where(twin, low[mate], 0).astype(np.uint64), high + np.where(twin, high[mate], 0).astype(np.uint64)
            sig = mix(mix(both_low + (both_high << np.uint64(11))) ^ mix(both_high + key * np.uint64(0x9E3779B97F4A7C15)))
            full = cnt > 0
            out_s.append(sig[full])
            out_d.append(docs[owner[full]])
            out_l.append(np.full(len(out_d[-1]), down))
            part = (np.cumsum(parts) - parts)[owner] + np.where(wide[owner], cell // 3, cell)
            holed = np.bincount(part, weights=~full, minlength=int(parts.sum())) > 0
            again = np.bincount(np.repeat(np.arange(len(docs)), parts), weights=holed, minlength=len(docs)) > spare
            use = np.zeros(len(n), bool)
            use[docs[again]] = True
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d), np.concatenate(out_l)


def level_bounds(tokens: dict[int, int]) -> np.ndarray:
    """Where the signatures of each level begin between 0 and 1, in proportion to the tokens that sign for it, and a last 1."""
    weight = np.ones(max(tokens, default=0) + 2)
    for level, n in tokens.items():
        weight[max(level - 1, 0) : level + 1] += n
    return np.concatenate([[0.0], np.cumsum(weight) / weight.sum()])


def place_signatures(sig: np.ndarray, scheme: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures whose upper half lies in the range of their level."""
    low, high = np.floor(bounds[scheme] * 2.0**32), np.floor(bounds[scheme + 1] * 2.0**32)
    upper = np.floor(low + (high - low) * ((sig >> np.uint64(32)).astype(np.float64) / 2.0**32)).clip(0, 2.0**32 - 1).astype(np.uint64)
    return (upper << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF))


def _sets(texts: list[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for b, e in blocks(len(t) if t else 0 for t in texts):
        h, doc = shingle_sets(texts[b:e], k)
        yield b, e, h, doc, np.bincount(doc, minlength=e - b)


def _classes(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            n, cls, second = np.zeros((3, len(pdf)), np.int64)
            for b, e, h, doc, m in _sets(texts, k):
                n[b:e] = m
                cls[b:e], second[b:e] = digest_pairs(h, m)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": n, "cls": cls, "second": second})

    return run


def _combine(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures and their smallest class, and edges from the other classes to it."""
    order = np.argsort(sig, kind="stable")
    sig, cls = sig[order], cls[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(new)
    hub = np.minimum.reduceat(cls, at)
    of = hub[np.cumsum(new) - 1]
    odd = cls != of
    return sig[at], hub, cls[odd], of[odd]


def _pack(sig: np.ndarray, cls: np.ndarray) -> bytes:
    """48 bits of each signature (equal ends only add candidates) and an index into the classes."""
    names, at = np.unique(cls, return_inverse=True)
    kind = np.uint16 if len(names) < 65536 else np.uint32
    return struct.pack("<ii", len(sig), len(names)) + names.tobytes() + at.astype(kind).tobytes() + sig.astype(np.uint32).tobytes() + (sig >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<ii", blob)
    at = 8
    names = np.frombuffer(blob, np.int64, m, at)
    kind = np.uint16 if m < 65536 else np.uint32
    at += 8 * m
    index = np.frombuffer(blob, kind, n, at)
    at += index.nbytes
    low = np.frombuffer(blob, np.uint32, n, at)
    high = np.frombuffer(blob, np.uint16, n, at + 4 * n)
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), names[index]


def _send(k: int, percent: int, buckets: int, bounds: np.ndarray, shared: np.ndarray):
    """Rows (bucket, kind, blob): of kind 0 combined signatures, of kind 1 edges found in the task."""

    def flush(sigs: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        sig, hub, a, b = _combine(np.concatenate(sigs), np.concatenate(owners))
        edges = star_forest(a, b) if len(a) else (a, b)
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cutp = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
        rows = [(i, 0, _pack(sig[s:e], hub[s:e])) for i, (s, e) in enumerate(zip(cutp[:-1], cutp[1:])) if e > s]
        for i in range(0, len(edges[0]), 50_000):
            rows.append((int(edges[0][i]) % buckets, 1, np.concatenate([edges[0][i : i + 50_000], edges[1][i : i + 50_000]]).tobytes()))
        for i in range(0, len(rows), 64):
            yield pd.DataFrame(rows[i : i + 64], columns=["bucket", "kind", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0
        for pdf in batches:
            texts = pdf.loc[pdf["doc_id"].notna(), "text"].tolist()
            for _, _, h, doc, n in _sets(texts, k):
                cls = set_digests(h, n, shared)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):  # one of a task's equal sets signs for all
                    if (c := int(cls[i])) not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > 2_000_000:
                    seen.clear()
                mine = fresh[doc]
                s, d, down = signatures(h[mine], doc[mine], np.where(fresh, n, 0), percent)
                scheme = np.searchsorted(levels(percent, int(n.max(initial=1)))[0], n[d], side="right") - 1 - down
                sigs.append(place_signatures(s, scheme, bounds))
                owners.append(cls[d] | down)
                held += len(s)
                if held >= FLUSH:
                    yield from flush(sigs, owners)
                    sigs, owners, held = [], [], 0
        if held:
            yield from flush(sigs, owners)

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of one bucket: those that tasks found, and those of signatures that several tasks sent."""
    pairs = [_unpack(b) for b, kind in zip(pdf["blob"], pdf["kind"]) if kind == 0]
    found = [np.frombuffer(b, np.int64).reshape(2, -1) for b, kind in zip(pdf["blob"], pdf["kind"]) if kind == 1]
    a, b = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    if pairs:
        _, _, c, d = _combine(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        a, b = np.concatenate([a, c]), np.concatenate([b, d])
    a, b = star_forest(a, b) if len(a) else (a, b)
    return pd.DataFrame({"a": a, "b": b})


def _fetch(k: int, shared: np.ndarray):
    """Token sets of the family members, each with its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, want = pdf["text"].tolist(), pdf["cls"].to_numpy()
            slots = [(pdf[f"fam{x}"].to_numpy(), pdf[f"nb{x}"].to_numpy()) for x in (0, 1)]
            for b, e, h, doc, n in _sets(texts, k):
                cls = set_digests(h, n, shared)
                at = np.concatenate([[0], np.cumsum(n)])
                rows = []
                for i in range(e - b):
                    if n[i] and cls[i] == want[b + i]:  # else another row of the same doc_id
                        blob = h[at[i] : at[i + 1]].tobytes()
                        place = int(mix(np.array([cls[i]]).view(np.uint64))[0] >> np.uint64(1))
                        for fam, nb in slots:
                            if m := int(nb[b + i]):
                                blk = place % m
                                rows.append((fam[b + i], m, blk, blk, blk, cls[i], blob))
                if rows:
                    yield pd.DataFrame(rows, columns=["fam", "nb", "bi", "bj", "blk", "cls", "tokens"])

    return run


def _deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens of a family's sets by ranges of their hashes, as many as the family has blocks: half of each token, and its set's class."""
    held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    n = 0

    def flush() -> Iterator[pd.DataFrame]:
        for (fam, nb), sets in held.items():
            tokens = np.concatenate([t for _, t in sets])
            owner = np.repeat(np.array([c for c, _ in sets], np.int64), [len(t) for _, t in sets])
            part = ((tokens >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            owner, half = owner[order], tokens[order].astype(np.uint32)
            ends = np.searchsorted(part[order], np.arange(nb + 1).astype(np.uint64))
            rows = [(fam, i, owner[s:e].tobytes(), half[s:e].tobytes()) for i, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
            yield pd.DataFrame(rows, columns=["fam", "part", "owners", "halves"])

    for pdf in batches:
        for fam, nb, cls, blob in zip(pdf["fam"], pdf["nb"], pdf["cls"], pdf["tokens"]):
            tokens = np.frombuffer(blob, np.uint64)
            held.setdefault((int(fam), int(nb)), []).append((cls, tokens))
            n += len(tokens)
        if n > DEALT_TOKENS:
            yield from flush()
            held, n = {}, 0
    yield from flush()


def _count_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many tokens of each set other sets hold too, in one range of a family (equal halves only add)."""
    owner, half = (np.concatenate([np.frombuffer(b, kind) for b in pdf[c]]) for c, kind in (("owners", np.int64), ("halves", np.uint32)))
    _, at, n = np.unique(half, return_inverse=True, return_counts=True)
    cls, shared = np.unique(owner[n[at] > 1], return_counts=True)
    return pd.DataFrame({"fam": np.full(len(cls), pdf["fam"].iloc[0]), "cls": cls, "shared": shared})


def _shared_enough(sets: DataFrame, percent: int, block_sets: int, block_tokens: int) -> DataFrame:
    """The sets of large families of which so many tokens are in other sets that they may link, dealt to blocks anew."""
    dealt = sets.select("fam", "nb", "cls", "tokens").mapInPandas(_deal, "fam long, part long, owners binary, halves binary")
    counts = dealt.groupBy("fam", "part").applyInPandas(_count_shared, "fam long, cls long, shared long").groupBy("fam", "cls").agg(F.sum("shared").alias("shared"))
    n = F.length("tokens") / 8
    kept = cut(sets.select("fam", "cls", "tokens").join(counts, ["fam", "cls"]).filter(F.col("shared") * 100 >= n * percent).drop("shared"))
    blocks_of = kept.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum(n) / block_tokens)).cast("long").alias("nb"))
    blk = F.pmod(F.xxhash64("cls"), F.col("nb"))
    return kept.join(blocks_of, "fam").select("fam", "nb", blk.alias("bi"), blk.alias("bj"), blk.alias("blk"), "cls", "tokens")


def _bit(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each token in a block's union."""
    at = tokens >> np.uint64(64 - UNION_BITS)
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def _unions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The token union of each block as bits, and its least and largest set; rows come in order of block."""

    def done() -> pd.DataFrame:
        return pd.DataFrame([(*key, bits.tobytes(), small, large)], columns=["fam", "blk", "bits", "small", "large"])

    key, bits, small, large = None, None, 0, 0
    for pdf in batches:
        for fam, blk, blob in zip(pdf["fam"], pdf["blk"], pdf["tokens"]):
            tokens = np.frombuffer(blob, np.uint64)
            if key != (fam, blk):
                if key:
                    yield done()
                key, bits, small, large = (fam, blk), np.zeros(1 << (UNION_BITS - 3), np.uint8), len(tokens), len(tokens)
            at, bit = _bit(tokens)
            np.bitwise_or.at(bits, at, bit)
            small, large = min(small, len(tokens)), max(large, len(tokens))
    if key:
        yield done()


def _open(percent: int):
    """Of each set (kind 1) the blocks that it overlaps enough, among the unions (kind 0) that come before it under its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, unions = None, []
        for pdf in batches:
            rows = []
            for fam, home, part, kind, other, bits, small, large, cls in zip(*(pdf[c] for c in ("fam", "home", "part", "kind", "blk", "bits", "small", "large", "cls"))):
                if key != (fam, home, part):
                    key, unions = (fam, home, part), []
                if kind == 0:
                    unions.append((other, np.frombuffer(bits, np.uint8), small, large))
                    continue
                tokens = np.frombuffer(bits, np.uint64)
                size, need = len(tokens), -(-percent * len(tokens) // 100)
                at, bit = _bit(tokens)
                for j, union, least, most in unions:
                    if most * 100 >= percent * size and size * 100 >= percent * least and np.count_nonzero(union[at] & bit) >= need:
                        rows.append((fam, min(home, j), max(home, j), home, cls, bits))
            if rows:
                yield pd.DataFrame(rows, columns=["fam", "bi", "bj", "blk", "cls", "tokens"])

    return run


def _exchanged(home: DataFrame, percent: int) -> DataFrame:
    """What blocks of the same family send one another: (fam, bi, bj, blk, cls, tokens)."""
    order = ["fam", "blk"]
    unions = cut(home.repartition(*order).sortWithinPartitions(*order).mapInPandas(_unions, "fam long, blk long, bits binary, small long, large long"))
    none = F.lit(0).cast("long")  # not null, which would make the column one of floats
    asked = unions.select("fam", F.col("blk").alias("home")).join(unions, "fam").filter("home != blk")  # unions meet by family, a row a pair of blocks
    asked = asked.select("fam", "home", F.floor(F.col("blk") / UNIONS).alias("part"), F.lit(0).alias("kind"), "blk", "bits", "small", "large", none.alias("cls"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("nb") - 1) / UNIONS))
    sets = home.select("fam", F.col("blk").alias("home"), F.explode(parts).alias("part"), F.lit(1).alias("kind"), none.alias("blk"), F.col("tokens").alias("bits"), none.alias("small"), none.alias("large"), "cls")
    keys = ["fam", "home", "part"]
    return asked.unionByName(sets).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInPandas(_open(percent), "fam long, bi long, bj long, blk long, cls long, tokens binary")


def link_sets(cls: list[int], sets: list[np.ndarray], blk: list[int], cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets, by the token-group matrix; cross: only links between blocks."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]), cls[i]))  # groups of like sizes, and there of like smallest hash
    cls, sets, blk = [cls[i] for i in order], [sets[i] for i in order], [blk[i] for i in order]
    size = np.array([len(s) for s in sets])
    uniq, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    local = [flat[e - m : e] for e, m in zip(ends, size)]
    groups = [(i, min(i + GROUP_SETS, len(sets))) for i in range(0, len(sets), GROUP_SETS)]
    unions = [np.unique(flat[ends[b] - size[b] : ends[e - 1]]) for b, e in groups]
    small, large = [int(size[b:e].min()) for b, e in groups], [int(size[b:e].max()) for b, e in groups]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(len(uniq), bool)
    out = []
    for i in range(len(sets)):
        mark[local[i]] = True
        a = int(size[i])
        need = -(-percent * a // 100)
        for g in range(i // GROUP_SETS, len(groups)):
            b, e = groups[g]
            if large[g] * 100 < percent * a or a * 100 < percent * small[g]:
                continue
            if np.count_nonzero(mark[unions[g]]) < need:  # the bound: no member can overlap more than the union
                continue
            for j in range(max(b, i + 1), e):
                if cross and blk[j] == blk[i] or min(a, size[j]) * 100 < percent * max(a, size[j]) or find(j) == find(i):
                    continue
                both = int(np.count_nonzero(mark[local[j]]))
                if 100 * both >= percent * (a + int(size[j]) - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
                    out.append((cls[i], cls[j]))
        mark[local[i]] = False
    return out


def _verify(percent: int):
    def solve(rows: list[tuple]) -> pd.DataFrame:
        seen: dict[int, tuple] = {}
        for r in rows:
            seen.setdefault(r[4], r)
        rows = list(seen.values())
        edges = link_sets([r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], [r[3] for r in rows], rows[0][1] != rows[0][2], percent) if len(rows) > 1 else []
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # of one key; rows come in order of it
        done: list[pd.DataFrame] = []
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if held and held[0][:3] != r[:3]:
                    done.append(solve(held))
                    held = []
                held.append(r)
            if len(done) > 500:
                yield pd.concat(done)
                done = []
        if held:
            done.append(solve(held))
        if done:
            yield pd.concat(done)

    return run


def _linked(docs: DataFrame, k: int, percent: int, block_sets: int, block_tokens: int, broadcast_rows: int, local_edges: int, suspect: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, n_shingles, cls) of every row; (named_cls, of, component) of the classes of more than one row or with a link: a
    class that names the component, and the smallest doc_id in it; and the digests that are shared, or taken to be (suspect)."""
    docs = lean(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = cut(docs.mapInPandas(_classes(k), "doc_id long, n_shingles long, cls long, second long"))
    twice = rows.groupBy("cls").agg(F.min("second").alias("least"), F.max("second").alias("most")).filter("least != most").select("cls").collect()
    shared = np.array(sorted({r["cls"] for r in twice} | set(suspect)), np.int64)
    rows = rows.withColumn("cls", F.when(F.col("cls").isin(shared.tolist()), F.col("second")).otherwise(F.col("cls"))) if len(shared) else rows
    rows = rows.drop("second")
    total, longest = (x or 0 for x in rows.agg(F.sum("n_shingles"), F.max("n_shingles")).first())
    tokens: dict[int, int] = {}
    if percent < 100:  # a count a level, as many as the logarithm of the longest text
        first = [int(x) for x in levels(percent, longest)[0]]
        level = F.size(F.filter(F.lit(first), lambda x: x <= F.col("n_shingles"))) - 1
        tokens = {x["level"]: x["tokens"] for x in rows.filter("n_shingles > 0").groupBy(level.alias("level")).agg(F.sum("n_shingles").alias("tokens")).collect()}
    buckets = max(1, total * (100 - percent) // 30 // BUCKET_SIGNATURES + 1)
    sent = docs.mapInPandas(_send(k, percent, int(buckets), level_bounds(tokens), shared), "bucket long, kind int, blob binary")
    family = components(sent.groupBy("bucket").applyInPandas(_meet, "a long, b long"), local_edges)
    family = family.select("node", F.col("comp").alias("fam"))
    family = cut(family.union(family.select(F.col("fam").alias("node"), "fam").distinct()))
    family = family.select(F.col("node").bitwiseAND(F.lit(-2).cast("long")).alias("cls"), F.col("node").bitwiseAND(F.lit(1).cast("long")).alias("down"), "fam")
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    whole = linked.groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    member = whole.join(small_side(family, family.count(), broadcast_rows), "cls")
    size = member.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n_shingles") / block_tokens)).cast("long").alias("nb"), F.min("down").alias("own"))
    member = member.join(size.filter("own = 0").drop("own"), "fam")
    slots = [F.coalesce(F.max(F.when(F.col("down") == x, F.col(c))), F.lit(0).cast("long")).alias(f"{c}{x}") for x in (0, 1) for c in ("fam", "nb")]
    member = cut(member.groupBy("cls").agg(F.min("low").alias("doc_id"), *slots))
    n_member = member.count()

    def fetched(which: str) -> DataFrame:  # the sets of the families whose number of blocks is such
        some = member.filter(f"nb0 {which} or nb1 {which}").withColumnRenamed("doc_id", "member_id").select("member_id", "cls", "fam0", "nb0", "fam1", "nb1")
        asked = with_ids(docs, "doc_id", some, n_member, broadcast_rows).select("text", "cls", "fam0", "nb0", "fam1", "nb1")
        return asked.mapInPandas(_fetch(k, shared), "fam long, nb long, bi long, bj long, blk long, cls long, tokens binary").filter(f"nb {which}")

    keys = ["fam", "bi", "bj"]

    def linked_in(sets: DataFrame) -> DataFrame:
        return sets.select(*keys, "blk", "cls", "tokens").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_verify(percent), "a long, b long")

    links = linked_in(fetched("= 1"))
    if member.filter("nb0 > 1 or nb1 > 1").limit(1).count():
        large = cut(_shared_enough(cut(fetched("> 1")), percent, block_sets, block_tokens))
        links = links.unionByName(linked_in(large))
        if large.filter("nb > 1").limit(1).count():
            links = links.unionByName(linked_in(_exchanged(large.filter("nb > 1"), percent)))
    comp = cut(components(links, local_edges))
    found = comp.select(F.col("node").alias("cls"), F.col("comp").alias("of")).union(comp.select(F.col("comp").alias("cls"), F.col("comp").alias("of")).distinct())
    # every class of a component, or with copies, gets the smallest doc_id; all others keep their own
    odd = whole.join(small_side(found, n_member, broadcast_rows), "cls", "left").filter("copies > 1 or of is not null").withColumn("of", F.coalesce("of", "cls"))
    low = cut(odd.select("cls", "of", "low"))
    least = low.groupBy("of").agg(F.min("low").alias("component"))
    return rows, cut(low.join(least, "of").select(F.col("cls").alias("named_cls"), "of", "component")), shared


def _name(rows: DataFrame, named: DataFrame, broadcast_rows: int) -> DataFrame:
    named = small_side(named.drop("of"), named.count(), broadcast_rows)
    on = (F.col("cls") == F.col("named_cls")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return rows.join(named, on, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS, broadcast_rows: int = 100_000, local_edges: int = LOCAL_EDGES, suspect: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    return _name(*_linked(docs, k, percent, block_sets, block_tokens, broadcast_rows, local_edges, suspect)[:2], broadcast_rows)


def _add_classes(k: int, at: int, shared: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            n, cls = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for b, e, h, doc, m in _sets(texts, k):
                n[b:e], cls[b:e] = m, set_digests(h, m, shared)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(cls)], names=[*batch.schema.names, *names])

    return run


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of docs, with all their columns, but for those that link with another one that stays: of each component one row
    of the smallest doc_id stays. Rows are told apart by their sets, so an id may stand for several texts; of equal rows
    without shingles one stays."""
    rows, named, shared = _linked(docs, k, percent, BLOCK_SETS, BLOCK_TOKENS, broadcast_rows, LOCAL_EDGES)
    gone_id, again_id, size, cls, own, of, low = (free_name(docs.columns, x) for x in ("gone_id", "again_id", "set_size", "set_digest", "named_digest", "component_of", "component_low"))
    gone = cut(_name(rows, named, broadcast_rows).filter("component_id != doc_id").select(F.col("doc_id").alias(gone_id)))
    again = cut(docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(again_id)).count().filter("count > 1").select(again_id))
    n, n_gone = again.count(), gone.count()
    if not n:
        return with_ids(docs, "doc_id", gone, n_gone, broadcast_rows, "left_anti")
    once = with_ids(docs, "doc_id", again.union(gone).distinct(), n + n_gone, broadcast_rows, "left_anti")
    many = lean(with_ids(docs, "doc_id", again, n, broadcast_rows, "left_semi"))  # ids of several rows: their texts tell which component each row is of
    schema = StructType([*many.schema.fields, StructField(size, LongType()), StructField(cls, LongType())])
    many = cut(many.mapInArrow(_add_classes(k, docs.columns.index("text"), shared, [size, cls]), schema))
    empty = many.filter(F.col(size) == 0).dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    named = named.select(F.col("named_cls").alias(own), F.col("of").alias(of), F.col("component").alias(low))
    held = many.filter(F.col(size) > 0).join(small_side(named, named.count(), broadcast_rows), F.col(cls) == F.col(own), "left")
    alone = held.filter(F.col(own).isNull()).select(*docs.columns)
    first = held.filter(F.col("doc_id") == F.col(low)).groupBy(of).agg(F.min_by(F.struct(*docs.columns), F.struct(cls, "text")).alias("row")).select("row.*")
    return once.unionByName(empty).unionByName(alone).unionByName(first)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 90 percent, over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLE_SQL = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), lk AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), reach(src, dst) AS (SELECT DISTINCT a, a FROM lk UNION SELECT r.src, b.b FROM reach r JOIN lk b ON r.dst = b.a
), c AS (SELECT src, min(dst) AS component_id FROM reach GROUP BY src)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.src"""
}
