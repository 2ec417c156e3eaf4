"""The citation scan over JDBC (the database that Spark ships): filter and columns reach the source, ranges come from it."""

from reviewlake.sources import outputs


def test_scan_is_pushed_and_dealt(spark, tmp_path):
    rows = [(f"p{i}", f"title {i}", i % 7 - 1, i, "iclr" if i % 3 else "other", "unused") for i in range(200)]
    url = f"jdbc:derby:{tmp_path}/papers"
    types = "id VARCHAR(20), normalized_title VARCHAR(50), conference VARCHAR(10), more VARCHAR(10)"
    spark.createDataFrame(rows, "id string, normalized_title string, gs_citation int, pos int, conference string, more string").coalesce(1).write.format("jdbc").option("url", url + ";create=true").option("dbtable", "papers").option("createTableColumnTypes", types).save()
    want = sorted((i, t, c, p) for i, t, c, p, conf, _ in rows if conf == "iclr")
    for by, parts in ((None, 1), ("pos", 4)):
        found = outputs.load_citations(spark, url, by=by, parts=4)
        assert sorted(map(tuple, found.collect())) == want and found.rdd.getNumPartitions() == parts
        plan = found._jdf.queryExecution().executedPlan().toString().lower()
        scan = plan[plan.index("scan jdbc") :]
        assert "equalto(conference,iclr)" in scan.replace(" ", "") and "more" not in scan.split("readschema")[1]
    assert outputs.load_citations(spark, url, "none", by="pos").count() == 0
