"""Each operator on rows with nulls in every column, empty and long texts, repeated rows, and extra columns whose names clash with its own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, exact_topk, html_extract, jaccard, language_id, mixing, secret_scan, substring_dedup, token_counts, toxicity

EXTRA = "n long, cls string, run string, first string, other string, holder string, score string, gram long, band int, bin int, place string, before string, toxic string, doc int, t string, x int, item_id string, spans string, component_id string, count int, held_out string, rate double, of string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
WIDTH = SCHEMA.count(",") + 1
WORDS = "river stone water light under people great mountain small green house tree over with".split()


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, *[None] * (WIDTH - 4))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(31)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)) + "."
    long = " ".join(rng.choice(WORDS) + rng.choice(["", "s", "."]) for _ in range(20_000))
    rows = [row(i, text(30)) for i in range(20)]
    rows += [row(3, rows[3][1]), row(3, text(12)), row(4, rows[5][1]), row(None, rows[0][1]), row(None, None, None, None), row(None, None, None, None)]
    rows += [row(30, None), row(31, "", None), row(32, " \t\n"), row(33, long), row(34, long + " end"), row(35, "x" * 300_000), row(36, "é𝄞 　 ñ", "es", None), row(37, "password=" + "a1B2" * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def ids(df, name="doc_id"):
    return Counter(r[name] for r in df.select(name).collect())


def test_language_id(docs):
    model = language_id.fit_filter(docs)
    got = language_id.predict_language(docs, model)
    assert ids(got) == ids(docs) and {r[0] for r in got.filter("doc_id in (30, 31, 32)").select("lang_pred").collect()} == {"und"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {30, 31, 32} & set(ids(kept)) and {33, 34, 3} <= set(ids(kept))
    assert language_id.predict_language(docs.limit(0), model).count() == 0


def test_mixing(docs):
    once = mixing.mix_sources(docs, weights={"s": 1.0, "other": 0.5})
    again = mixing.mix_sources(docs, weights={"s": 1.0, "other": 0.5})
    assert once.columns == [*docs.columns, "n_copies", "copy", "shuffle_key"]
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))  # the same draw each time
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_token_counts(docs):
    hist = {r["n_tokens"]: r["n_docs"] for r in token_counts.length_histogram(docs).collect()}
    assert sum(hist.values()) == docs.count() and hist[0] == 4


def test_toxicity(spark, docs):
    marks = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 5 > 0, 0).alias("toxic"), F.lit("x").alias("text"), F.lit(1).alias("place"))
    model = toxicity.fit_model(docs, marks)
    got = toxicity.score_toxicity(docs, model)
    assert ids(got) == ids(docs) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_model(docs, marks.limit(0))).filter("score != 0").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_exact_topk(spark):
    extra = "terms string, v string, block int, rank int, score double, query_id long, side int"
    rows = [(i, [0.5, float(i % 3)], *[None] * 7) for i in range(60)] + [(50, [0.5, 2.0], *[None] * 7), (None, [1.0], *[None] * 7), (61, None, *[None] * 7), (62, [], *[None] * 7)]
    got = exact_topk.exact_topk(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {extra}"), k=3).collect()
    assert {r["query_id"]: [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == r["query_id"]] for r in got} == {0: [1, 2, 3], 50: [2, 5, 8]}


def test_substring_dedup(docs):
    got = substring_dedup.dedup_substrings(docs)
    assert ids(got) == ids(docs) and got.filter("doc_id = 30 and text is null").count() == 1 and got.filter("doc_id = 31 and text = ''").count() == 1
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_jaccard(docs):
    got = jaccard.jaccard_components(docs)
    assert ids(got) == ids(docs)
    held = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert held[30, 0] == 30 and held[31, 0] == 31 and {c for (i, n), c in held.items() if i in (33, 34)} == {33} and {c for (i, _), c in held.items() if i is None} == {None}
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 34 not in ids(kept) and ids(kept)[None] == 3 and ids(kept)[3] == 2
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = docs.filter("doc_id in (1, 2)").select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("doc_id"), F.lit("s").alias("score")).union(spark.createDataFrame([(None, None, None, None), (7, "", 1, "")], "item_id long, text string, doc_id int, score string"))
    found = decontaminate.find_contamination(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.filter("score = 1").collect()} >= {(1, 1), (2, 2)}
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and not {1, 2} & set(ids(kept)) and {30, 31, 35} <= set(ids(kept))
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_secrets(docs):
    got = secret_scan.scan_secrets(docs)
    assert ids(got) == ids(docs) and got.filter("n_assign = 1").count() == 1 and got.filter("doc_id = 30 and spans = ''").count() == 1
    red = secret_scan.redact_secrets(docs)
    assert red.columns == docs.columns and ids(red) == ids(docs) and red.filter("doc_id = 37").first()["text"] == "[SECRET]" and red.filter("doc_id = 30").first()["text"] is None
    assert secret_scan.redact_secrets(docs.limit(0)).count() == 0


def test_html(spark):
    extra = "host string, wrapper string, path string, items string, expression string, page_host string, text string, n_chars int"
    rows = [(i, u, h, *[None] * 8) for i, u, h in [(1, "http://a/x", "<p>One</p>"), (1, "http://a/x", "<p>One</p>"), (2, None, None), (None, "http://a/y", "<p>Two"), (3, "nonsense", ""), (4, "http://a/z", "<p>" + "w " * 200_000), (5, "", "<script>x()")]]
    got = Counter(tuple(r) for r in html_extract.extract_pages(spark.createDataFrame(rows, f"page_id long, url string, html string, {extra}")).collect())
    assert got[1, "http://a/x", "One", 3] == 2 and got[2, None, "", 0] == got[None, "http://a/y", "Two", 3] == got[3, "nonsense", "", 0] == got[5, "", "", 0] == 1
    assert {t[3] for t in got if t[0] == 4} == {399_999}
