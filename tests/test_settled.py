"""Settled rows lie where page work needs them, and wide columns are stored once."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import QUERIES, bronze, page_tables
from folioframe.operators import edits as D
from folioframe.operators import scans
from folioframe.operators import walk as W
from folioframe.operators.merges import ROW_KEY
from folioframe.plans import extract as X
from folioframe.session import settle, tune
from folioframe.sources import catalog
from folioframe.sources.layout import PAGE_KEY, span_of

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    return spark.range(4000).select((F.col("id") % 7).alias("doc_id"), (F.col("id") % 300 + 1).cast("int").alias("page"), F.col("id").cast("int").alias("ri")).withColumn(
        "span", span_of("page"))


def test_page_work_moves_no_settled_rows(spark):
    a, b = settle(_rows(spark)), settle(_rows(spark).withColumnRenamed("ri", "other").withColumn("ri", F.col("other")))
    joined = a.join(b.hint("merge"), ROW_KEY).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE_KEY)))
    assert "Exchange" not in _plan(joined)
    assert joined.count() == 4000
    again = settle(joined)
    assert "Exchange" not in _plan(again.groupBy(*PAGE_KEY).agg(F.max("n")))


def test_scans_move_summaries_only(spark):
    a = settle(_rows(spark).withColumn("payload", F.lit("x")))
    plan = _plan(scans.doc_scan(a, ["page", "ri"], n=("sum", F.lit(1))))
    assert not [line for line in plan.splitlines() if "Exchange" in line and "payload" in line]
    assert "Exchange hashpartitioning" in plan
    many = scans.doc_scan(a, ["page", "ri"], n=("sum", F.lit(1)))
    assert many.groupBy("doc_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).where("n <> c - 1").count() == 0


def test_packed_rows_are_not_broadcast_by_the_size_of_their_files(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    held = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "64k")
        tune(spark)
        wide, slim = settle(_rows(spark).withColumn("payload", F.lit("x"))), settle(_rows(spark))
        # 4,000 rows: some 30 KB as files, 160 KB as rows.
        every, few = wide.join(slim, ROW_KEY), wide.join(spark.range(7).withColumnRenamed("id", "doc_id"), "doc_id")
        assert len(every.collect()) == 4000 and "Broadcast" not in _plan(every)
        # What has been shuffled and is small is broadcast as before.
        assert len(few.collect()) == 4000 and "BroadcastHashJoin" in _plan(few)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["analyzed_documents", "both_projections", "reader_views", "chain_members", "footnotes_of_linear"])
def test_no_side_is_broadcast_unmeasured(spark, name):
    import __spark_entry__  # noqa: F401

    plan = _plan(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_walk_stores_texts_and_lines_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(W, "settle", lambda df: stored.append(df.columns) or settle(df))
    w = X.walked(bronze(spark, SF))
    assert [("lines" in c, "text" in c) for c in stored] == [(True, True), (False, False)]
    assert "line_text" not in stored[0]
    assert w.where("bt <> 'Equation' and line_text <> text").count() == 0


def test_walk_stores_no_text_that_its_lines_make(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(W, "settle", lambda df: stored.append(settle(df)) or stored[-1])
    X.walked(bronze(spark, SF))
    assert stored[0].where("bt <> 'Equation' and text is not null").count() == 0
    assert stored[0].where("text is not null").count() > 0


def test_whole_rows_are_stored_once_after_the_merges(spark, monkeypatch):
    w, stored = settle(X.walked(bronze(spark, SF))), []
    monkeypatch.setattr(X, "settle", lambda df: stored.append("sentences" in df.columns) or settle(df))
    X.finish_pages(W.page_rows(w))
    assert stored == [True, False]
    stored.clear()
    X.finish_linear(W.linear_rows(w))
    assert stored == [True, True, True, False, False]


def test_pages_are_nested_where_their_rows_lie(spark):
    x = X.extract_both(bronze(spark, SF))
    info = x.pages.select("doc_id").distinct().selectExpr("doc_id", "'a' filename", "'m' global_map", "'en' language")
    plan = _plan(catalog.nest_analysis(x.pages, x.page_rows, x.linear, x.metadata, info))
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and ", page#" in line.split("),")[0] and "span" not in line.split("),")[0]]


def test_pages_and_drawings_move_no_text(spark):
    for df in page_tables(spark, SF).values():
        assert "Exchange" not in _plan(df)


def _overrides(spark):
    fields = "doc_id long, key string, n int, page int, x0 double, y0 double, x1 double, y1 double, role string, continuation boolean, allow_merges boolean"
    rows = [(1, "2:5", 1, None, *[None] * 4, "ignored", None, None), (1, "img:70:6", 2, None, *[None] * 4, "figure", None, None), (1, "L:2:5:5", 3, None, *[None] * 4, "lost", None, None),
            (1, "nothing", 4, None, *[None] * 4, "lost", None, None), (1, "99999999999:5", 5, None, *[None] * 4, "lost", None, None), (2, "2:5", 6, None, *[None] * 4, "lost", None, None)]
    return spark.createDataFrame(rows, fields)


def test_overrides_move_to_the_rows(spark):
    places = [(1, 2, 5, "block"), (1, 70, 6, "image"), (1, 70, 6, "block"), (1, 2, 6, "block"), (3, 2, 5, "block")]
    rows = spark.createDataFrame([(*p, "paragraph", False, "some text", 0.0, 0.0, 9.0, 9.0) for p in places],
                                 "doc_id long, page int, ri int, kind string, role string, continuation boolean, text string, x0 double, y0 double, x1 double, y1 double").withColumn("span", span_of("page"))
    settled, few = settle(rows), _overrides(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = D.apply_overrides_pages(settled, few)
        on_linear = D.apply_overrides_linear(settled, few, settled)
        on_metadata = D.apply_overrides_metadata(settled.drop("role"), few.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(9.0), "y1": F.lit(9.0), "page": F.col("n")}))
        for df in (out, on_linear, on_metadata):
            scan = [line for line in _plan(df).splitlines() if "FileScan" in line and "text" in line]
            assert scan and "Bucketed: true" in scan[0]
        got = {(r.doc_id, r.page, r.ri, r.kind): r.role for r in out.collect()}
        assert got == {(1, 2, 5, "block"): "ignored", (1, 70, 6, "image"): "figure", (1, 70, 6, "block"): "paragraph", (1, 2, 6, "block"): "paragraph", (3, 2, 5, "block"): "paragraph"}
        assert {(r.page, r.ri): r.role for r in on_linear.where("doc_id = 1 and page = 2").collect()} == {(2, 5): "ignored", (2, 6): "ignored"}
        plain = D.apply_overrides_pages(rows.drop("span"), few)
        assert {(r.doc_id, r.page, r.ri, r.kind): r.role for r in plain.collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
