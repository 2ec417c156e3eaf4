"""Queries of joins, splits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import lookups as L
from reviewlake.operators import prefixes as P
from reviewlake.operators import splits as W
from reviewlake.operators import statistics as S
from reviewlake.plans.funnel import PAPERS_SQL, papers
from reviewlake.plans.registry import query
from reviewlake.sources import files as IO


@query(
    "two_key_lookup",
    """WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t, (p_size - 10)::BIGINT AS c FROM part WHERE p_partkey % 3 <> 0),
t AS (SELECT t, arg_max(c, id) AS c FROM p GROUP BY t)
SELECT d.p_partkey, CASE WHEN coalesce(p.c, t.c) >= 0 THEN coalesce(p.c, t.c) END AS gs_citation FROM part d LEFT JOIN p ON d.p_partkey = p.id LEFT JOIN t ON regexp_replace(lower(d.p_name), '[^a-z0-9]', '', 'g') = t.t""",
)
def two_key_lookup(load):
    """J1."""
    from reviewlake.functions.text import title_key

    cites = load("part").filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("id"), title_key(F.col("p_name")).alias("normalized_title"), (F.col("p_size") - 10).cast("long").alias("gs_citation"), F.col("p_partkey").alias("pos"))
    return L.two_key_lookup(load("part"), cites, "p_partkey", "p_name").select("p_partkey", "gs_citation")


_IDS_SQL = "i AS (SELECT (2020 + doc_id % 3)::INTEGER AS year, doc_id::VARCHAR AS id FROM documents), x AS (SELECT (2020 + page_id % 3)::INTEGER AS year, page_id::VARCHAR || '_' || length(url)::VARCHAR AS stem, (page_id % 2)::INTEGER AS priority FROM pages)"


def _ids(load):
    return load("documents").select((2020 + F.col("doc_id") % 3).cast("int").alias("year"), F.col("doc_id").cast("string").alias("id"))


def _stems(load):
    return load("pages").select((2020 + F.col("page_id") % 3).cast("int").alias("year"), F.concat_ws("_", F.col("page_id").cast("string"), F.length("url").cast("string")).alias("stem"), (F.col("page_id") % 2).cast("int").alias("priority"), F.col("url").alias("path"))


@query("prefix_match", f"WITH {_IDS_SQL} SELECT i.year, i.id, min(x.stem) AS stem FROM i LEFT JOIN x ON i.year = x.year AND starts_with(x.stem, i.id) GROUP BY ALL")
def prefix_match(load):
    """J2."""
    return P.prefix_lookup(_ids(load), _stems(load)).select("year", "id", "stem")


@query("prefix_match_delimited", f"WITH {_IDS_SQL} SELECT i.year, i.id, min(x.stem) AS stem FROM i LEFT JOIN x ON i.year = x.year AND (x.stem = i.id OR starts_with(x.stem, i.id || '_')) GROUP BY ALL")
def prefix_match_delimited(load):
    """J4."""
    return P.prefix_lookup(_ids(load), _stems(load), delimiter="_").select("year", "id", "stem")


@query("priority_match", f"WITH {_IDS_SQL} SELECT i.year, i.id, arg_min(x.stem, (x.priority, x.stem)) AS stem FROM i LEFT JOIN x ON i.year = x.year AND starts_with(x.stem, i.id) GROUP BY ALL")
def priority_match(load):
    """J3."""
    return P.priority_lookup(_ids(load), _stems(load)).select("year", "id", "stem")


@query("latest_before_cutoff", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest FROM events WHERE ts < (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY user_id")
def latest_before_cutoff(load):
    """J8, W2."""
    events = load("events")
    first = events.agg(F.min("ts")).first()[0]
    return L.latest_before(events, "user_id", "ts", "event_id", F.col("event_id"), F.lit(first) + F.expr("INTERVAL 10 DAYS"))


@query("revision_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS revision FROM events WHERE user_id IS NOT NULL")
def revision_number(load):
    """P12, W3."""
    events = load("events").filter("user_id is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return L.revision_numbers(events, "user_id", "ts", "event_id").select("event_id", "revision")


@query("avg_revisions", "SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS average FROM events GROUP BY event_type")
def avg_revisions(load):
    """A10."""
    return load("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u")).select("event_type", "n", F.round(F.col("n") / F.col("u"), 6).alias("average"))


@query(
    "reply_counts",
    """WITH c AS (SELECT conv_id AS forum, turn, conv_id::VARCHAR || '/' || turn::VARCHAR AS id, conv_id::VARCHAR || '/' || (turn - 1)::VARCHAR AS replyto, CASE WHEN turn % 2 = 1 THEN 'Authors' ELSE 'Reviewer_' || (turn % 4)::VARCHAR END AS sig FROM conversations),
r AS (SELECT * FROM c WHERE turn % 2 = 0)
SELECT r.forum, r.id, count(DISTINCT a.id) AS author_replies, count(b.id) AS reviewer_replies FROM r LEFT JOIN c a ON a.replyto = r.id AND a.forum = r.forum AND contains(a.sig, 'Authors')
LEFT JOIN c b ON b.replyto = a.id AND b.forum = a.forum AND contains(b.sig, r.sig) GROUP BY r.forum, r.id""",
)
def reply_counts(load):
    """J9."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    c = load("conversations").select(
        F.col("conv_id").alias("forum"), "turn", F.concat_ws("/", conv, turn.cast("string")).alias("id"), F.concat_ws("/", conv, (turn - 1).cast("string")).alias("replyto"), F.when(turn % 2 == 1, "Authors").otherwise(F.concat(F.lit("Reviewer_"), (turn % 4).cast("string"))).alias("signatures")
    )
    return L.reply_counts(c.filter("turn % 2 = 0").select("forum", "id", F.col("signatures").alias("reviewer")), c)


@query("changed_rows", "SELECT o_orderkey, o_totalprice AS old_value, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS new_value FROM orders WHERE o_orderkey % 7 = 0")
def changed_rows(load):
    """J7."""
    o = load("orders").select("o_orderkey", "o_totalprice")
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return L.changed(o, new, "o_orderkey", "o_totalprice")


@query("anti_resume", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber AND d.l_returnflag = 'R')")
def anti_resume(load):
    """J6."""
    li = load("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return L.not_done(li.select("l_orderkey", "l_linenumber"), li.filter("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


@query("semi_valid", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_valid(load):
    """J5."""
    return L.only_known(load("customer").select("c_custkey"), load("orders").filter("o_totalprice > 200000"), "c_custkey", "o_custkey")


@query("manifest_replace", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) = 1995 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def manifest_replace(load):
    """S19."""
    o = load("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    return IO.replace_year(o, o.filter("year = 1995").withColumn("status", F.lit("new")), 1995, ["year", "o_orderkey"])


@query("last_wins", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def last_wins(load):
    """U4, S2."""
    return L.last_wins(load("conversations").select("conv_id", "role", "turn"), "conv_id", "turn")


@query("assembly", """SELECT o_orderkey, c_name, n_name, k FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def assembly(load):
    """A chain of joins, the many side aggregated first."""
    per = load("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    out = L.with_dimension(load("orders").join(load("customer"), F.col("o_custkey") == F.col("c_custkey")), load("nation"), "c_nationkey", "n_nationkey", "n_name")
    return L.with_dimension(out, per, "o_orderkey", "l_orderkey", "k").select("o_orderkey", "c_name", "n_name", "k")


@query(
    "key_sets",
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) SELECT k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)",
)
def key_sets(load):
    """U1-U3."""
    a, b = load("orders").select(F.col("o_custkey").alias("k")), load("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return L.key_sides(a, b, "k")


@query("first_n_per_group", f"WITH {PAPERS_SQL} SELECT year, submission_id FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY submission_id) AS rn FROM papers) WHERE rn <= 10")
def first_n_per_group(load):
    """W1."""
    return W.first_per_group(papers(load).select("year", "submission_id"), "year", "submission_id", 10)


@query(
    "task_splits",
    """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS t FROM orders)
SELECT o_orderkey, i AS row_index, t AS first_larger, least(i // (n // 7), 6) AS last_larger, i % 7 AS strided, i // 2200 AS chunk FROM i""",
)
def task_splits(load):
    """W5-W9."""
    orders = load("orders").select("o_orderkey")
    n, i = orders.count(), F.col("row_index")
    rows = W.row_index(orders, "o_orderkey")
    return rows.select("o_orderkey", "row_index", W.split_first_larger(i, n, 7).alias("first_larger"), W.split_last_larger(i, n, 7).alias("last_larger"), W.split_strided(i, 7).alias("strided"), W.chunk(i, 2200).alias("chunk"))


@query("fixed_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 50")
def fixed_sample(load):
    """O3, O4."""
    return W.sample(load("documents").select("doc_id"), "doc_id", 50)


@query("stratified_sample", f"WITH {PAPERS_SQL} SELECT year, submission_id FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5(submission_id::VARCHAR || '-42'), submission_id) AS rn, count(*) OVER (PARTITION BY year) AS n FROM papers) WHERE rn <= greatest(1, floor(n * 0.1::DOUBLE))")
def stratified_sample(load):
    """O5."""
    return W.stratified_sample(papers(load).select("year", "submission_id"), "year", "submission_id", 0.1)


_BALANCED_SQL = f"""WITH {PAPERS_SQL}, b AS (SELECT year, submission_id, CASE WHEN decision = 'Spotlight' THEN 'accept' ELSE 'reject' END AS label, n_chars > 500 AS complete FROM papers),
r AS (SELECT *, row_number() OVER (PARTITION BY year, label ORDER BY complete DESC, md5(submission_id::VARCHAR || '-42'), submission_id) AS rn, count_if(label = 'accept') OVER (PARTITION BY year) AS pos FROM b)
SELECT year, submission_id, label FROM r WHERE label = 'accept' OR rn <= pos"""


def _labelled(load):
    return papers(load).select("year", "submission_id", F.when(F.col("decision") == "Spotlight", "accept").otherwise("reject").alias("label"), (F.col("n_chars") > 500).alias("complete"))


@query("balanced_sample", _BALANCED_SQL)
def balanced_sample(load):
    """O6."""
    return W.balanced_sample(_labelled(load), "year", "submission_id", "label", "complete").select("year", "submission_id", "label")


@query(
    "contamination_split",
    f"""WITH {PAPERS_SQL}, p AS (SELECT year, submission_id, CASE WHEN submission_id % 10 = 1 THEN 'test' WHEN submission_id % 10 = 2 THEN 'train' END AS pinned FROM papers),
r AS (SELECT *, (year IN (2024, 2025) AND pinned IS NOT NULL) AS fixed, count(*) OVER (PARTITION BY year) AS n, count_if(pinned = 'test') OVER (PARTITION BY year) AS t,
  row_number() OVER (PARTITION BY year, (year IN (2024, 2025) AND pinned IS NOT NULL) ORDER BY md5(submission_id::VARCHAR || '-42'), submission_id) AS rn FROM p)
SELECT year, submission_id, CASE WHEN year IN (2024, 2025) THEN CASE WHEN fixed THEN pinned WHEN rn <= greatest(0, floor((1.0::DOUBLE - 0.8::DOUBLE) * n) - t) THEN 'test' ELSE 'train' END
  WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def contamination_split(load):
    """O7."""
    rows = papers(load).select("year", "submission_id", F.when(F.col("submission_id") % 10 == 1, "test").when(F.col("submission_id") % 10 == 2, "train").alias("pinned"))
    return W.contamination_split(rows, "year", "submission_id", "pinned").select("year", "submission_id", "split")


@query("top_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_counts(load):
    """O1, O2."""
    return S.top_values(load("orders"), "o_orderpriority", 3)


@query("missing_shards", "SELECT range AS shard FROM range(100) WHERE range NOT IN (SELECT DISTINCT doc_id % 100 FROM documents WHERE doc_id % 100 < 90)")
def missing_shards(load):
    """S16."""
    return IO.missing_shards(load("documents").select((F.col("doc_id") % 100).alias("shard")).filter("shard < 90").distinct(), 100)


@query("latest_rows", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts)::VARCHAR AS ts FROM events GROUP BY user_id")
def latest_rows(load):
    """W2."""
    events = load("events").select("user_id", "event_id", "ts").withColumn("_at", F.struct("ts", "event_id"))
    return L.latest_revision(events, "user_id", "_at").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"))
