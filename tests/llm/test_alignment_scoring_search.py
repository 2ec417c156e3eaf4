"""Token alignment, language-model scoring and ranked search against brute force, with nulls, repeats, ties, long texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import lm_scoring as L
from reviewlake.llm import ranked_search as R
from reviewlake.llm import token_alignment as T

EXTRA = "row string, block string, kind string, part int, score string, query int, n_docs string, groups string, held_out string, rank string"
SCHEMA = f"doc_id long, text string, {EXTRA}"
NONE = (None,) * (EXTRA.count(",") + 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, *NONE) for r in rows], SCHEMA).repartition(3)


def prose(rng, n):
    syllables = "the of and tion er on re ing be wh at é ß".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize() if rng.random() < 0.2 else rng.choice(syllables) for _ in range(n)) + rng.choice([".", "!\n", ""])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, prose(rng, rng.randint(1, 60))) for i in range(90)]
    out += [(90 + i, out[i][1]) for i in range(15)] + [(3, out[3][1]), (3, "other text"), (None, out[5][1]), (None, None)]
    odd = [None, "", " ", "a", " a ", "a  b", "a \n b\n", "<|endoftext|> <s> x</s>", "▁a b", "é 𝄞 　x \xa0 y", "it's  we'll 12 3a!", "x" * 3000, " " * 900 + "q", "a\x00b \x1cq r\x1d s", "ends \n", "e ́x ﬁ ½", "tab\tand\rcr", "a"]
    return out + [(200 + i, t) for i, t in enumerate(odd)] + [(300, prose(rng, 4000))]


# --- alignment --------------------------------------------------------------------------------------------------------


def aligned(rows):
    """Whole texts encoded one by one."""
    both = T.tokenizer(T.VOCABULARY_A, T.VOCABULARY_B)
    out, counts = [], Counter()
    for i, text in rows:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        a_bytes, b_bytes = [both.bytes_a[x] for x in a], [both.bytes_b[x] for x in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a = b = []
        ends = [dict(zip(accumulate(map(len, names)), range(len(names)))) for names in (a_bytes, b_bytes)] if a else [{}, {}]
        cuts, groups, at = sorted(ends[0].keys() & ends[1].keys()), [], (0, 0)
        for c in cuts:
            to = (ends[0][c] + 1, ends[1][c] + 1)
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            at = to
        links = [(a[ends[0][c]], b[ends[1][c]]) for c in cuts]
        counts.update(links)
        out.append((i, len(a), len(b), links, ";".join(groups)))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter((i, a, b, len(x), len(x), sum(counts[y] == top[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, x, g in out)


@pytest.mark.parametrize("bounds", [{}, {"chars": 300}, {"pairs_at_once": 40}])
def test_alignment(spark, rows, bounds):
    docs = table(spark, rows)
    assert Counter(map(tuple, T.align_tokens(docs, **bounds).collect())) == aligned(rows)


def test_alignment_forgets_and_parts(spark, rows, monkeypatch):
    both = T.tokenizer(T.VOCABULARY_A, T.VOCABULARY_B)
    small = T.Aligner(both, 20)  # forgets stretches between rounds
    for _, text in rows[:60]:
        code = small.codes(both.stretches(text))
        n, links = small.links_of(code)
        fresh = T.Aligner(both)
        again = fresh.codes(both.stretches(text))
        assert [small.groups[i] for i in code] == [fresh.groups[i] for i in again] and n.sum() == len(links) == fresh.counts[again, 2].sum()
    monkeypatch.setattr(both, "parts", False)  # vocabularies whose pieces cross spaces: whole texts
    assert both.stretches("a b") == ["a b"]
    some = [r for r in rows if r[1] and len(r[1]) < 300][:20]
    assert len(T.Aligner(both).codes([t for _, t in some])) == 20
    groups = T.aligned_groups(table(spark, [(1, "it is"), (2, None)])).orderBy("place").collect()
    assert [r["doc_id"] for r in groups] == [1] * len(groups) and [both.bytes_a[i] for r in groups for i in r["a_ids"]] == [b" it", b" is"]
    assert T.align_tokens(table(spark, rows[:1]).limit(0)).count() == 0


# --- language model ---------------------------------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def scored(rows):
    kinds = [L.SCORED if i is None or (c := zlib.crc32(str(i).encode())) % 10 == 0 else L.LEFT_OUT if c % 40 == 1 else L.LEARNED for i, _ in rows]

    def counts(of):
        u, b, t = Counter(), Counter(), Counter()
        for (_, text), k in zip(rows, kinds):
            if k in of:
                w = [0, 0, *tokens(text)]
                u[0] += 1
                b[0, 0] += 1
                for j in range(2, len(w)):
                    u[w[j]] += 1
                    b[w[j - 1], w[j]] += 1
                    t[w[j - 2], w[j - 1], w[j]] += 1
        return u, b, t, sum(u.values()) - u[0], sum(k != 0 for k in u)

    def estimates(text, held):
        (u, b, t, n, _), w = held, [0, 0, *tokens(text)]
        for j in range(2, len(w)):
            n3, n2 = b[w[j - 2], w[j - 1]], u[w[j - 1]]
            yield (t[w[j - 2], w[j - 1], w[j]] / max(1, n3), n3.bit_length() - 1 if n3 else 63, b[w[j - 1], w[j]] / max(1, n2), n2.bit_length() - 1 if n2 else 63, u[w[j]] / max(1, n), u[w[j]])

    x3, x2, x1, before, kept = [0.5] * 63 + [0], [0.5] * 63 + [0], 0.5, -math.inf, counts({L.LEARNED})

    def terms(e, v):
        rest = (1 - x3[e[1]]) * (1 - x2[e[3]])
        return x3[e[1]] * e[0], (1 - x3[e[1]]) * x2[e[3]] * e[2], rest * x1 * e[4], rest * (1 - x1) / (v + 1)

    left_out = [e for (_, text), k in zip(rows, kinds) if k == L.LEFT_OUT for e in estimates(text, kept)]
    for _ in range(L.ROUNDS if left_out else 0):
        s, gain = Counter(), 0.0
        for e in left_out:
            q = terms(e, kept[4])
            p = sum(q)
            gain += math.log(p) / len(left_out)
            for name, k, some, all_ in ((3, e[1], q[0], p), (2, e[3], q[1], p - q[0]), (1, 0, q[2], q[2] + q[3])):
                s[name, k, "a"] += some / p
                s[name, k, "b"] += all_ / p
        x3, x2 = ([(s[name, k, "a"] + 1) / (s[name, k, "b"] + 2) for k in range(63)] + [0] for name in (3, 2))
        x1 = (s[1, 0, "a"] + 1) / (s[1, 0, "b"] + 2)
        if gain - before < L.PRECISION:
            break
        before = gain
    held = counts({L.LEARNED, L.LEFT_OUT})
    n, v = held[3:]
    x1 = x1 if n else 0
    out = []
    for (i, text), k in zip(rows, kinds):
        e = list(estimates(text, held))
        out.append((i, k == L.SCORED, len(e), sum(x[5] > 0 for x in e), n, sum(math.log10((x[5] + 0.1) / (n + 0.1 * (v + 1))) for x in e), sum(math.log10(sum(terms(x, v))) for x in e)))
    return out


def same_scores(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


@pytest.mark.parametrize("bounds", [{}, {"size": 700, "part_ngrams": 300}])
def test_lm_scores(spark, rows, bounds):
    found, model = L.fit_and_score(table(spark, rows), **bounds)
    same_scores(found.collect(), scored(rows))
    assert all(0 < x < 1 for x in (*model.three[:-1], *model.two[:-1], model.one))


def test_lm_without_learning_rows(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    for rows in ([(held_out, "a b"), (None, "a")], [(1, "A b"), (held_out, "a B c")]):
        found, _ = L.fit_and_score(table(spark, rows))
        same_scores(found.collect(), scored(rows))
    assert L.fit_and_score(table(spark, rows).limit(0))[0].count() == 0


def test_lm_is_a_distribution(spark, rows):
    """Over the known words and one unknown word, probabilities after a context sum up to 1."""
    found, model = L.fit_and_score(table(spark, [r for r in rows if r[0] is not None and r[0] < 60]))
    f3, f2, f1 = [0.5, 0.5, 0, 0], [0.25, 0.25, 0.5, 0], [0.1, 0.2, 0.3, 0.4]
    small = L.Model(model.three, model.two, model.one, 10, 4)
    p = sum(L._terms(small, np.array([*f3, 0.0]), np.full(5, 2), np.array([*f2, 0.0]), np.full(5, 3), np.array([*f1, 0.0])))
    assert math.isclose(p.sum(), 1)
    assert found.filter(F.col("score") <= F.col("base_score")).count() < found.count() / 2


# --- ranked search ----------------------------------------------------------------------------------------------------


def ranked(rows, items, k):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(find(t))) for i, t in rows]
    n, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(find(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // max(1, length)
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t]), i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1) if s]
    return sorted(out)


@pytest.mark.parametrize("chars", [R.QUERY_CHARS, 60])
def test_ranked_search(spark, rows, monkeypatch, chars):
    monkeypatch.setattr(R, "BLOCK_DOCS", 40)
    monkeypatch.setattr(R, "QUERY_ROWS", 3)
    items = [(0, "The of"), (1, "er ER, tion-wh é"), (1, "at"), (2, None), (3, "zzz"), (4, " ".join(t for _, t in rows[:3])), (None, "the"), (5, "x" * 3000 + " it"), (6, "other")]
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = R.search(table(spark, rows), queries, chars=chars).collect()
    assert sorted(map(tuple, got)) == ranked(rows, items, R.K)


def test_ranked_search_ties_and_empties(spark):
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(7, "same words here"), (None, "same words here"), (50, "")]
    queries = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = sorted(map(tuple, R.search(table(spark, rows), queries).collect()))
    assert got == ranked(rows, [(1, "words")], R.K) and [g[2] for g in got] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert R.search(table(spark, rows).limit(0), queries).count() == 0 == R.search(table(spark, rows), queries.limit(0)).count()
