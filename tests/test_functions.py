"""Golden rows for the column functions, mostly the forms that converted papers take."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import decisions as D
from reviewlake.functions import markdown as M
from reviewlake.functions import text as X


def values(spark, fn, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_decisions(spark):
    given_ = ["Accept (Oral)", "notable-top-5%", "Talk", "Accept: notable-top-25%", "Poster", "accept", "Desk Reject", "Reject", "Withdrawn", "?", None]
    assert values(spark, D.normalize_decision, given_) == ["Accept (Oral)"] * 3 + ["Accept (Spotlight)", "Accept (Poster)", "Accept (Poster)", "Desk Reject", "Reject", "Withdrawn", "Unknown", "Unknown"]
    assert values(spark, D.venue_decision, ["ICLR 2023 notable top 5%", "poster", "Desk Rejected", "Submitted", ""]) == ["Accept (Oral)", "Accept (Poster)", "Desk Reject", "Unknown", "Unknown"]
    assert values(spark, D.coarse_decision, ["Withdrawn after reject", "Reject", "Poster", None]) == ["Withdrawn", "Reject", "Accept", "Unknown"]


def test_scores_and_ages(spark):
    assert values(spark, D.score_prefix, ["5: marginally below", "3 good", " 8", "n/a", None, "99999999999999999999"]) == [5, 3, 8, None, None, None]
    assert values(spark, D.horizons, [0, 1, 3, 9], "int") == [[], [1], [1, 2, 3], [1, 2, 3, 4, 5, 6]]
    assert values(spark, lambda c: D.percent(c, F.lit(400)), [1, 9], "int") == [0.2, 2.2]
    assert values(spark, D.citation_percentile, [0, 50, 500], "int") == [0.1, 0.5, 0.95]


def test_text(spark):
    assert values(spark, X.title_key, ["A Title: of 2!", None]) == ["atitleof2", "none"]
    assert values(spark, X.clean_header, ["<span id='x'>a</span> **Bold** ", " *x*"]) == ["Bold", "x"]
    assert values(spark, X.anonymize_abstract, ["One. See https://github.com/a.b now. Two!  Three?"]) == ["One. Two! Three?"]
    assert values(spark, X.remove_git_sentences, ["One. See https: //x.gitlab.io. Two.", "None here."]) == ["One. Two.", "None here."]
    assert values(spark, X.outer_json, ['so {"a": {"b": 1}} ok', "} {", "none", '{"a"', ""]) == ['{"a": {"b": 1}}', None, None, None, None]
    assert values(spark, X.pdf_hash, ["/pdf/abc.pdf", "/attachment/abc.pdf", None]) == ["abc", "", ""]
    assert values(spark, X.reviewer_id, ["ICLR.cc/2024/Submission1/Reviewer_xY", "ICLR.cc/2020/Paper1/AnonReviewer10", "ICLR.cc/Authors"]) == ["Reviewer_xY", "AnonReviewer10", None]


def test_answers(spark):
    given_ = ["Reasoning: good.\nAnswer: Accept", "Answer: I reject", "no label", "Answer: accept, not reject"]
    assert values(spark, X.answer_decision, given_) == ["Accept", "Reject", None, "Accept"]
    assert values(spark, X.reasoning, given_) == ["good.", None, None, None]
    assert values(spark, X.answer_rating, ["Answer: 7.5", "Answer: 11", "Answer: none"]) == [7.5, None, None]
    assert values(spark, X.answer_ratio, ["Answer: 85", "Answer: 0.85", "Answer: 850"]) == [0.85, 0.85, None]
    assert values(spark, lambda c: X.answer_counts(c, 3), ["Answer: 3, 4", "Answer: 1 2 3 4"]) == [[3, 4, None], [1, 2, 3]]


HEADERS = {"# Abstract": True, "## **ABSTRACT**": True, "ABSTRACT": True, "# <span>Abstract</span>": True, "# A B S T R A C T": True, "# Abstracts of": False, "In the abstract": False}


def test_header_detectors(spark):
    assert values(spark, M.has_abstract_header, list(HEADERS)) == list(HEADERS.values())
    assert values(spark, M.has_references, ["# References", "REFERENCES", "# R E F E R E N C E S", "reference manual"]) == [True, True, True, False]
    assert values(spark, M.has_acknowledgement, ["### **Acknowledgements**", "Acknowledgement", "# Acknowledging help"]) == [True, False, True]
    assert values(spark, lambda c: M.has_acknowledgement(c, broad=False), ["### **Acknowledgements**", "# Acknowledgment of help"]) == [True, False]
    assert [bool(re.search(M.ABSTRACT, h, re.I | re.M)) for h in HEADERS] == list(HEADERS.values())  # the same in both dialects


def test_line_cleaners(spark):
    assert values(spark, M.strip_line_numbers, ["a **054 055 056** b", "x\n327\ny", "x\n337 338\ny"]) == ["a  b", "x\n\ny", "x\n\ny"]
    assert values(spark, M.strip_footnotes, ["<sup>1</sup> https://x", "<sup>(</sup>a) kept", "† fig 3", "‡ Equal", 'a <span id="page-8-4"></span>b']) == ["", "<sup>(</sup>a) kept", "† fig 3", "", "a b"]


PAPER = """# Title
## Abstract
The abstract. See https://x.org/a now.
# 1 <span id="p">x</span>**Introduction**
Body.  

**054 055**

327

<sup>1</sup> footnote
## Reproducibility Statement
Gone.
### Deep
Gone too.
# Acknowledgements
Thanks.
# 2 Results
Done.
References
[1] A.
# Appendix
More."""


def test_clean_text():
    assert M.clean_text(PAPER) == "# 1 INTRODUCTION\n\nBody.\n\n# 2 RESULTS\n\nDone.\n\n# REFERENCES\n\n[1] A."
    assert M.clean_text("no headers") is None and M.clean_text(None) is None and M.clean_text("# Abstract\nx\n# 1 Intro\ny") is None


def test_implicit_abstract_and_sections():
    long = "word " * 60
    assert M.Document(f"# Title\n{long}\n# 1 Introduction\nx").abstract()[0] == long.strip()
    assert M.Document("# Title\nshort\n# 1 Introduction\nx").abstract() is None
    got = M.sections_of("# 1 Intro\na\n## 1.2 More **b**\nc")
    assert [(s["level"], s["number"], s["title"], s["content"]) for s in got] == [(1, "1", "Intro", "a"), (2, "1.2", "More b", "c")]


def test_url_sentences():
    assert M.drop_sentences_with("One. See https://x/y now. Two.", re.compile(M.URL, re.I)) == "One. Two."


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n.", max_size=30), min_size=1, max_size=20))
def test_whitespace_rule_matches_python(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    assert values(spark, X.normalize_whitespace, texts) == [M.tidy(t) for t in texts]


def test_links_and_broken_links_take_their_sentences(spark):
    texts = {"One. See https://a.org/x?y=1. Two.": "One. Two.", "Code at https:// github.com/x now.": "com/x now.", "HTTP://": "", "A http:// b. C  d": "C d", "none\n here": "none here", "Left (http://). Stays.": "Stays."}
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", M.without_url_sentences("t").alias("u")).collect()
    assert {r.t: r.u for r in rows} == texts
