"""Secret scans (operator 9): fixed patterns plus a randomness test battery, with DataFrame functions only.

Fixed patterns give the base spans: assign, access and hex. The battery adds spans of kind random. Candidates are whole
runs of 20 or more of [A-Za-z0-9+/_=-] with a digit. Each run's encoding is inferred from its characters (hexadecimal,
base 32, 36, 62 or 64). Three tests, at LEVEL together, must not reject that it is random: chi-squared uniformity over that
alphabet (exact critical values up to EXACT characters, the Wilson-Hilferty approximation with the statistic's own mean and
variance beyond), runs above and below its middle, and serial correlation of neighbours (both with their moments at the
token's length). And the hypothesis that it is ordinary text must be rejected: two characters of text agree at least as often
as two English letters of that alphabet do. Those p-values go through a false-discovery control in each length band
(Benjamini and Hochberg, on the histogram of p-values of all candidates, rounded up to tenths of a decade; one small row
a band and bin), so that many or short candidates need stronger evidence. Random spans that overlap base spans are dropped.

Positions come from running sums over a text's matches by doubling, so a text of m matches costs m log m and its length.
Redaction cuts the text once a span.

Positions count code points, the end exclusive; spans are whole matches. Null and empty texts have no spans; rows with null
ids and repeated rows stand for themselves; extra columns are ignored (scan) or kept (redact); no cap on length or count.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import free_name, table

KINDS = ("assign", "access", "hex", "random")
# Equal to the contract's patterns after failing matches are dropped; runs are anchored at their first character.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Keywords of ASSIGN in lower case; texts without any need no matching.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Level of the randomness tests together, and of the false-discovery control.
LEVEL, FALSE_DISCOVERY = 0.001, 0.01
#: Length up to which critical values of uniformity are exact.
EXACT = 128
#: English letters a to z, percent (fixed values).
LETTERS = (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074)
DIGITS = "0123456789"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": DIGITS + "abcdefghijklmnopqrstuvwxyz",
    "BASE36": DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz" + DIGITS + "+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz" + DIGITS + "-_",
}
_SPAN = "array<struct<start:int,kind_no:int,end:int,body:string>>"


def _scan(array: str, kind: str, nothing: str, join: str) -> str:
    """SQL for running values of an array under an associative join of x (before) and y, by doubling."""
    return f"""aggregate(filter(sequence(0, 30), k -> shiftleft(1, k) < size({array})), {array},
      (s, k) -> zip_with(concat(array_repeat(cast({nothing} as {kind}), shiftleft(1, k)), slice(s, 1, size(s) - shiftleft(1, k))), s, (x, y) -> {join}))"""


def _matches(text: str, pattern: str, kind_no: int, keep: str, when: str) -> str:
    """SQL for the array of kept spans of one kind: gaps come from split, matches from regexp_extract_all."""
    lit = "r'" + pattern.replace("'", "\\x27") + "'"
    found, gaps = f"regexp_extract_all({text}, {lit}, 0)", f"split({text}, {lit}, -1)"
    steps = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> length(g) + length(m))"
    ends = f"get(transform(array({steps}), w -> {_scan('w', 'int', '0', 'x + y')}), 0)"
    return f"""
      case when {when} then
        filter(zip_with({ends}, {found}, (e, m) -> named_struct('start', e - length(m), 'kind_no', {kind_no}, 'end', e, 'body', m)), x -> {keep})
      else cast(array() as {_SPAN}) end"""


def base_spans(text: str) -> str:
    """SQL for the base spans of a column, as an array of (start, kind_no, end, body)."""
    assign = "r'" + ASSIGN.replace("'", "\\x27") + "'"
    has_key = " or ".join(f"contains(lower({text}), '{w}')" for w in KEYWORDS)
    parts = [
        _matches(text, ASSIGN, 0, f"length(regexp_extract(x.body, {assign}, 2)) >= 6", f"({has_key})"),
        _matches(text, ACCESS, 1, "true", f"contains({text}, 'AKIA')"),
        _matches(text, HEX, 2, "true", f"{text} rlike r'[0-9a-f]{{24}}'"),
    ]
    return f"concat({', '.join(parts)})"


def _normal_tail(z: str) -> str:
    """SQL for P(Z > z), to a relative error of about 1e-7 in both tails (the Chebyshev form of erfc), not under 1e-300."""
    t = f"(1D / (1D + 0.5D * abs({z}) / sqrt(2D)))"
    series = "0.17087277D"
    for c in ("-0.82215223D", "1.48851587D", "-1.13520398D", "0.27886807D", "-0.18628806D", "0.09678418D", "0.37409196D", "1.00002368D", "-1.26551223D"):
        series = f"({c} + {t} * {series})"
    tail = f"greatest(1e-300D, 0.5D * {t} * exp(-({z}) * ({z}) / 2D + {series}))"
    return f"(case when {z} >= 0 then {tail} else 1D - {tail} end)"


def text_rates(alphabet: str) -> tuple[float, float]:
    """Chances that two, and that three, English letters agree, given that all are in the alphabet."""
    held = [f for i, f in enumerate(LETTERS) if chr(97 + i) in alphabet.lower()]
    return sum((f / sum(held)) ** 2 for f in held), sum((f / sum(held)) ** 3 for f in held)


@lru_cache(None)
def critical_pairs(cells: int, longest: int = EXACT, chance: float = LEVEL / 3) -> tuple[int, ...]:
    """For each length from 1: the least number of equal pairs that so many characters, uniform over the cells, reach with a chance
    of at most chance. Exact: cells are filled one after the other; counts of pairs too high to matter fall off the table's end."""
    rate = longest / cells
    top = int(longest * (longest - 1) / (2 * cells) + 10 * (rate + 1) * np.sqrt(cells) + 60)
    n = np.arange(longest + 1)
    dist = np.zeros((longest + 1, top + 1))  # of pairs, for each length, over the cells so far
    ok = n * (n - 1) // 2 <= top
    dist[n[ok], (n * (n - 1) // 2)[ok]] = 1
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, longest + 1)))])
    for j in range(2, cells + 1):
        out = np.zeros_like(dist)
        for k in range(longest + 1):
            pairs = k * (k - 1) // 2
            if pairs > top:
                break
            m = n[k:]
            weight = np.exp(log_fact[m] - log_fact[k] - log_fact[m - k] - k * np.log(j) + (m - k) * np.log1p(-1 / j))
            if weight.max() < 1e-14:
                if k > longest / j:
                    break
                continue
            out[k:, pairs:] += weight[:, None] * dist[: longest + 1 - k, : top + 1 - pairs]
        dist = out
    tail = 1 - np.concatenate([np.zeros((longest + 1, 1)), np.cumsum(dist, axis=1)], axis=1)  # chance of at least so many pairs
    return tuple(int(np.argmax(row <= chance)) for row in tail[1:])


_KIND = """case when t rlike '^[0-9a-f]+$' then 'hex' when t rlike '^[0-9A-F]+$' then 'HEX' when t rlike '^[A-Z2-7]+$' then 'base32'
  when t rlike '^[a-z0-9]+$' then 'base36' when t rlike '^[A-Z0-9]+$' then 'BASE36' when t rlike '^[A-Za-z0-9]+$' then 'base62'
  when t rlike '^[A-Za-z0-9+/]+$' then 'base64' else 'base64url' end"""
_RATE = ["case k " + " ".join(f"when '{n}' then {text_rates(x)[i]!r}D" for n, x in ALPHABETS.items()) + " end" for i in (0, 1)]
_TWO_SIDED = NormalDist().inv_cdf(1 - LEVEL / 6)
_ALPHABET = "case " + " ".join(f"when k = '{n}' then '{a}'" for n, a in ALPHABETS.items()) + " end"
def _critical() -> str:
    """SQL for the array of critical_pairs() of an alphabet of a characters."""
    return "case cast(a as int) " + " ".join(f"when {n} then array({', '.join(map(str, critical_pairs(n)))})" for n in sorted({len(x) for x in ALPHABETS.values()})) + " end"


@lru_cache(None)
def battery() -> tuple[tuple[str, str], ...]:
    """The battery as named SQL expressions, each over those before it; t is the token without padding."""
    return (
        ("k", _KIND),
        ("alphabet", _ALPHABET),
        ("a", "cast(length(alphabet) as double)"),
        ("n", "length(t)"),
        ("codes", "transform(filter(split(t, ''), c -> c != ''), c -> cast(greatest(instr(alphabet, c) - 1, 0) as double))"),
        # equal pairs: in order, a code at place i + 1 whose value began at place f has i + 1 - f equal ones before it
        ("sorted", "array_sort(codes)"),
        ("pairs", "aggregate(sorted, named_struct('last', -1D, 'run', 0L, 'sum', 0L), (s, c) -> named_struct('last', c, 'run', case when c = s.last then s.run + 1 else 0L end, 'sum', s.sum + case when c = s.last then s.run + 1 else 0L end), s -> s.sum)"),
        ("mean", "aggregate(codes, 0D, (s, c) -> s + c) / greatest(n, 1)"),
        ("low", "cast(size(filter(codes, c -> c < a / 2)) as double)"),
        ("before", "concat(array(cast(null as double)), slice(codes, 1, greatest(n - 1, 0)))"),
        ("runs", "1 + size(filter(zip_with(before, codes, (x, y) -> (x < a / 2) != (y < a / 2)), x -> x))"),
        ("spread", "aggregate(codes, 0D, (s, c) -> s + (c - mean) * (c - mean))"),
        ("lagged", "aggregate(zip_with(before, codes, (x, y) -> coalesce((x - mean) * (y - mean), 0D)), 0D, (s, c) -> s + c)"),
        ("e_runs", "1 + 2D * low * (n - low) / greatest(n, 1)"),
        ("v_runs", "(e_runs - 1) * (e_runs - 2) / greatest(n - 1, 1)"),
        ("z_runs", "case when v_runs > 0 then (runs - e_runs) / sqrt(v_runs) else 9D end"),
        ("z_serial", "case when spread > 0 and n > 2 then (lagged / spread + 1D / n) / sqrt((n - 2D) * (n - 2D) / (1D * n * n * (n - 1D))) else 9D end"),
        ("freedom", "(a - 1) * n / greatest(n - 1D, 1D)"),
        ("too_many", f"case when n between 1 and {EXACT} then element_at({_critical()}, n) else ((n - 1D) / n * freedom * pow(1 - 2 / (9 * freedom) + {NormalDist().inv_cdf(1 - LEVEL / 3)!r}D * sqrt(2 / (9 * freedom)), 3) + n) * n / a / 2 - n / 2D end"),
        ("random", f"n > 0 and pairs < too_many and abs(z_runs) <= {_TWO_SIDED!r}D and abs(z_serial) <= {_TWO_SIDED!r}D"),
        ("all_pairs", "greatest(n * (n - 1D) / 2, 1D)"),
        ("k2", _RATE[0]),
        ("k3", _RATE[1]),
        ("z_text", "(k2 * all_pairs - pairs) / sqrt(all_pairs * k2 * (1 - k2) + n * (n - 1D) * greatest(n - 2D, 0D) * (k3 - k2 * k2))"),
        ("band", "cast(floor(log2(greatest(n, 1))) as int)"),
        ("bin", f"cast(floor(least(300D, -10 * log10({_normal_tail('z_text')}))) as int)"),
    )


def _with_tests(df: DataFrame, body: str) -> DataFrame:
    """df with the columns of the battery for a token column."""
    for name, value in [("t", f"regexp_replace({body}, '=+$', '')"), *battery()]:
        df = df.withColumn(name, F.expr(value))
    return df


def thresholds(docs: DataFrame, text: str = "text", level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Band of log2 length -> least bin that the false-discovery control accepts, over all candidates of all texts. Bounded: a band doubles the length."""
    tokens = docs.filter(f"{text} rlike r'[0-9]'").select(F.explode(F.expr(f"regexp_extract_all({text}, r'{RANDOM}', 0)")).alias("body"))
    hist = _with_tests(tokens, "body").groupBy("band", "bin").count()
    bands: dict[int, list[tuple[int, int]]] = {}
    for band, bin_, count in hist.collect():  # at most 31 bands of 301 bins
        bands.setdefault(band, []).append((bin_, count))
    out = {}
    for band, bins in bands.items():
        total, above = sum(c for _, c in bins), 0
        for bin_, count in sorted(bins, reverse=True):
            above += count
            if 10 ** (-bin_ / 10) * total <= level * above:
                out[band] = bin_
    return out


_APART = f"""transform(filter(transform(array(sort_array(concat(base, more))), w ->
  zip_with(zip_with(w, {_scan("transform(w, x -> case when x.kind_no < 3 then x.end else 0 end)", "int", "0", "greatest(x, y)")}, (x, e) -> named_struct('x', x, 'past', e)),
    reverse({_scan("reverse(transform(w, x -> case when x.kind_no < 3 then x.start else 2147483647 end))", "int", "2147483647", "least(x, y)")}),
    (p, n) -> named_struct('x', p.x, 'free', p.past <= p.x.start and p.x.end <= n)))[0], p -> p.x.kind_no = 3 and p.free), p -> p.x)"""


def with_spans(docs: DataFrame, text: str, base: str, every: str, accepted: dict[int, int] | None = None) -> DataFrame:
    """docs with two more columns, base and every: the base spans and all spans (start, kind_no, end, body) of the column text, in order."""
    accepted = thresholds(docs, text) if accepted is None else accepted
    value = f"coalesce(`{text}`, '')"
    df = docs.withColumn(base, F.expr(f"sort_array({base_spans(value)})"))
    if not accepted:
        return df.withColumn(every, F.col(base))
    limit = "case " + " ".join(f"when band = {b} then {n}" for b, n in sorted(accepted.items())) + " else 999 end"
    df = df.withColumn(every, F.expr(_matches(value, RANDOM, 3, "true", f"{value} rlike r'[0-9]'")))
    df = df.withColumn(every, F.expr(f"filter(`{every}`, x -> {_inline_test('x.body', limit)})"))
    apart = F.expr(f"case when size(`{every}`) = 0 or size(`{base}`) = 0 then `{every}` else {_APART.replace('concat(base, more)', f'concat(`{base}`, `{every}`)')} end")
    return df.withColumn(every, apart).withColumn(every, F.expr(f"case when size(`{every}`) = 0 then `{base}` else sort_array(concat(`{base}`, `{every}`)) end"))


def _inline_test(body: str, limit: str) -> str:
    """The battery as one SQL condition on a token, by nested lambdas over one-element arrays."""
    final = f"random and bin >= ({limit})"
    for name, value in reversed([("t", f"regexp_replace({body}, '=+$', '')"), *battery()]):
        final = f"exists(array({value}), {name} -> {final})"
    return final


_NAME = "case x.kind_no when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'random' end"


def _joined(array: str) -> str:
    return f"array_join(transform({array}, x -> concat({_NAME}, ':', cast(x.start as string), ':', cast(x.end as string))), ',')"


def scan_secrets(docs: DataFrame, accepted: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of docs(doc_id, text)."""
    df = with_spans(docs.select("doc_id", "text"), "text", "base_", "all_", accepted)
    count = {k: F.expr(f"cast(size(filter(all_, x -> x.kind_no = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)}
    return df.select("doc_id", count["assign"], count["access"], count["hex"], F.sha2(F.expr(_joined("base_")), 256).alias("base_sha256"), F.expr(_joined("all_")).alias("spans"), count["random"])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", accepted: dict[int, int] | None = None) -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); n_chars follows where it exists."""
    base, every = free_name(docs.columns, "base_spans"), free_name(docs.columns, "all_spans")
    df = with_spans(docs, "text", base, every, accepted)
    past = _scan(f"transform(`{every}`, x -> x.end)", "int", "0", "greatest(x, y)")
    # each span that begins at or after the end of all before it closes a stretch of kept text
    text = f"""case when size(`{every}`) = 0 then text else
      get(transform(array({past}), p -> concat(
        array_join(transform(`{every}`, (x, i) -> case when x.start < coalesce(get(p, i - 1), 0) then ''
          else concat(substring(text, coalesce(get(p, i - 1), 0) + 1, x.start - coalesce(get(p, i - 1), 0)), '{mark}') end), ''),
        substring(text, get(p, size(p) - 1) + 1))), 0) end"""
    out = df.withColumn("text", F.expr(text)).drop(base, every)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE_SQL: dict[str, str] = {}
