"""Whole-plan properties: spans, partitions, round trips, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.answer_checks import _info, echo_client, progress_events
from checks.registry import bronze
from folioframe.operators import scans
from folioframe.operators.jobs import job_status
from folioframe.plans import analyze as PA
from folioframe.plans import extract as X
from folioframe.sources import catalog, sample_layout
from folioframe.sources.layout import span_of
from folioframe.streaming import jobs as SJ

SF = "/root/testdata/sf0.001"


def test_scans_equal_plain_windows_over_many_spans(spark):
    rng = random.Random(3)
    rows = [(d, p, i, rng.choice([None, 1, 2, 3])) for d in range(3) for p in range(1, 400) for i in range(rng.randint(0, 3))]
    df = spark.createDataFrame(rows, "doc_id long, page int, ri int, v int").withColumn("span", span_of("page"))
    out = scans.doc_scan(df, ["page", "ri"], s=("sum", F.col("v")), l=("last", F.col("v")), n=("next", F.col("v")), t=("total_min", F.struct("page", "v")))
    w = Window.partitionBy("doc_id").orderBy("page", "ri")
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("doc_id", "page", "ri", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.last("v", True).over(up).alias("l"), F.first("v", True).over(down).alias("n"))
    cols = ["doc_id", "page", "ri", "s", "l", "n"]
    assert sorted(out.select(cols).collect(), key=str) == sorted(want.select(cols).collect(), key=str)
    assert df.select("span").distinct().count() > 5


def test_long_document_spans_do_not_change_results(spark, monkeypatch):
    """The same documents cut into spans of one page and of 64 pages give the same rows."""
    import folioframe.operators.ordering as O
    import folioframe.sources.layout as L

    def rows():
        x = X.extract_both(dict(layout))
        a = x.page_rows.select("doc_id", "page", "ri", "role", "text", "continuation", "caption_text").collect()
        b = x.linear.select("doc_id", "page", "ri", "role", "text", "continuation", "caption_text", "y1", "flat_block_ref").collect()
        return sorted(map(str, a)), sorted(map(str, b)), x.metadata.count()

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    layout = sample_layout.bronze(docs)
    layout.pop("recognized_lines")
    wide = rows()
    one = lambda page: (F.col(page) - 1).cast("int")
    monkeypatch.setattr(L, "span_of", one)
    monkeypatch.setattr(O, "span_of", one)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert rows() == wide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def extraction(spark):
    return X.extract_both(bronze(spark, SF))


def test_invariants(extraction):
    x = extraction
    dup = x.linear.groupBy("doc_id", "ri").count().where("count > 1").count()
    dup_pages = x.page_rows.groupBy("doc_id", "page", "ri").count().where("count > 1").count()
    assert dup == 0 and dup_pages == 0
    outside = x.page_rows.where("kind = 'block'").select("y0", "y1", F.explode("sentences").alias("s")).select("y0", "y1", F.explode("s.boxes").alias("b")).where(
        "b.y0 < y0 - 0.01 or b.y1 > y1 + 0.01").count()
    assert outside == 0


def test_analysis_round_trip(spark, extraction, fresh_dir):
    x = extraction
    maps = _info(spark, SF).withColumn("global_map", F.lit(None).cast("struct<acronyms:array<struct<term:string,definition:string>>,core_methodology:string,assumed_concepts:array<string>>"))
    nested = catalog.nest_analysis(x.pages, x.page_rows, x.linear, x.metadata, maps)
    catalog.write_analysis(nested, fresh_dir)
    catalog.write_analysis(nested.where("doc_id < 5"), fresh_dir)  # replaces five documents, keeps the others
    back = catalog.flatten_analysis(catalog.read_analysis(spark, fresh_dir))
    cols = ["doc_id", "page", "ri", "role", "text", "x0", "y1", "continuation"]
    for name, want in (("page_rows", x.page_rows), ("linear", x.linear)):
        assert sorted(map(str, back[name].select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert back["metadata"].count() == x.metadata.count()


def test_old_analysis_gets_defaults(spark, fresh_dir):
    import json
    import os

    os.makedirs(f"{fresh_dir}/a")
    old = {"doc_id": 1, "filename": "a.pdf", "page_count": 1, "pages": [{"page": 1, "blocks": [{"text": "t", "boxes": [{"x0": 1, "y0": 2, "x1": 3, "y1": 4}]}]}]}
    with open(f"{fresh_dir}/a/a.json", "w") as f:
        f.write(json.dumps(old))
    a = catalog.read_analysis(spark, f"{fresh_dir}/a")
    assert a.first()["language"] == "es"
    r = catalog.flatten_analysis(a)["page_rows"].first()
    assert (r["role"], r["ri"], r["continuation"], r["y1"]) == ("paragraph", 0, False, 4.0)


def test_catalog_of_real_files(spark, fresh_dir):
    for name in ("a.pdf", "b.pdf", "c.txt"):
        with open(f"{fresh_dir}/{name}", "wb") as f:
            f.write(b"x" * 10)
    done = spark.createDataFrame([("a.pdf",)], "filename string")
    got = {r["filename"]: r["has_analysis"] for r in catalog.document_catalog(catalog.read_files(spark, fresh_dir), done).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}


def test_stream_state_equals_batch(spark, fresh_dir):
    events = progress_events(spark, SF)
    events.repartition(4).write.parquet(f"{fresh_dir}/in")
    q = SJ.stream_job_state(SJ.read_progress(spark, f"{fresh_dir}/in", 1)).writeStream.outputMode("complete").format("memory").queryName("job_states").trigger(
        availableNow=True).option("checkpointLocation", f"{fresh_dir}/cp").start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("job_states").collect())) == sorted(map(str, job_status(events).collect()))


def test_finished_jobs_expire_and_open_jobs_stay(spark, fresh_dir):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "job_id long, event_id long, ts timestamp, phase string, message string, tier_index int, chunk_index int, total_chunks int"
    first = [(1, 1, at(0), "started", "", 0, 0, 0), (1, 2, at(1), "done", "", 0, 0, 0), (1, 3, at(2), "failed", "", 0, 0, 0), (2, 4, at(0), "started", "", 0, 0, 0)]
    for k, rows in enumerate([first, [(3, 5, at(200), "started", "", 0, 0, 0)], [(3, 6, at(201), "batch_oom", "", 0, 0, 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{fresh_dir}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{fresh_dir}/in")
    q = SJ.stream_job_ttl(source).writeStream.outputMode("update").format("memory").queryName("ttl").trigger(availableNow=True).option("checkpointLocation", f"{fresh_dir}/cp").start()
    q.awaitTermination()
    rows = [(r["job_id"], r["status"], r["phase"]) for r in spark.table("ttl").collect()]
    assert (1, "done", "done") in rows and (1, "expired", "done") in rows
    assert not any(j == 2 and s == "expired" for j, s, _ in rows) and not any(j == 1 and p == "failed" for j, _, p in rows)


def test_a_late_end_is_not_lost(spark, fresh_dir):
    """Job 1 ends at minute 30, but the event comes after another job's at minute 120."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    at = lambda m: now + dt.timedelta(minutes=m - 120)
    schema = "job_id long, event_id long, ts timestamp, phase string, message string, tier_index int, chunk_index int, total_chunks int"
    batches = [[(1, 1, at(0), "queued", "", 0, 0, 0)], [(2, 2, at(120), "started", "", 0, 0, 0)], [(1, 3, at(30), "done", "", 0, 0, 0)], [(1, 4, at(20), "failed", "", 0, 0, 0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{fresh_dir}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{fresh_dir}/in")
    q = SJ.stream_job_ttl(source, ttl_seconds=10**6).writeStream.outputMode("update").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", f"{fresh_dir}/cp").start()
    q.awaitTermination()
    rows = [(r["job_id"], r["status"], r["finished_at"]) for r in spark.table("late").collect()]
    # Files of one moment may come in any order; the last word is the earliest end either way.
    last = [r for r in rows if r[0] == 1][-1]
    assert last == (1, "failed", at(20)) and (2, "running", None) in rows


def test_documents_stream_once(spark, fresh_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 6")
    layout = sample_layout.bronze(docs)
    layout["layout_blocks"].where("doc_id < 3").write.parquet(f"{fresh_dir}/in")
    out, seen = f"{fresh_dir}/out", []

    def known():
        return spark.createDataFrame([(f"doc{d}.pdf",) for d in seen], "filename string")

    def analyze(blocks):
        tables = {**layout, "layout_blocks": blocks}
        tables.pop("recognized_lines", None)
        ids = sorted(r[0] for r in blocks.select("doc_id").distinct().collect())
        seen.extend(ids)
        tables["layout_pages"] = layout["layout_pages"].where(F.col("doc_id").isin(ids or [-1]))
        return PA.analyze(tables, _info(spark, SF).where(F.col("doc_id").isin(ids or [-1])), echo_client, wait=False)

    run = lambda: SJ.stream_documents(spark, f"{fresh_dir}/in", known, analyze, out, f"{fresh_dir}/cp").awaitTermination()
    run()
    layout["layout_blocks"].where("doc_id in (3, 4) or doc_id = 5 and page < 2").write.mode("append").parquet(f"{fresh_dir}/in")
    run()
    layout["layout_blocks"].where("doc_id = 5 and page >= 2").write.mode("append").parquet(f"{fresh_dir}/in")
    run()
    got = catalog.read_analysis(spark, out)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5]
    assert seen == [0, 1, 2, 3, 4, 5, 5]
    # The document that came in two files is as if it had come in one.
    tables = {k: v.where("doc_id = 5") for k, v in layout.items() if k != "recognized_lines"}
    want = PA.analyze(tables, _info(spark, SF).where("doc_id = 5"), echo_client, wait=False)
    assert str(got.where("doc_id = 5").select("page_count", "linear_blocks").collect()) == str(want.select("page_count", "linear_blocks").collect())


def test_store_replaces_and_appends_by_bucket(spark, fresh_dir):
    import os

    from folioframe.sources.store import MOST_VERSIONS, BucketStore

    schema = "doc_id bigint, v string"
    rows = lambda pairs: spark.createDataFrame(pairs, schema)
    store = BucketStore(spark, f"{fresh_dir}/s", schema, buckets=4)
    assert store.read().count() == 0 and store.touched(rows([])) == set()
    store.replace(rows([(i, "a") for i in range(50)] + [(None, "n")]))
    store.replace(rows([(3, "b"), (3, "c")]), keys=spark.createDataFrame([(4,)], "doc_id bigint"))
    want = [(i, "a") for i in range(50) if i not in (3, 4)] + [(3, "b"), (3, "c")]
    assert [tuple(r) for r in store.read().where("doc_id is not null").orderBy("doc_id", "v").collect()] == sorted(want)
    for k in range(MOST_VERSIONS + 3):
        store.append(rows([(7, f"k{k}")]), f"batch-{k}")
        store.append(rows([(7, f"k{k}")]), f"batch-{k}")  # a repeat counts once
    assert sorted(r["v"] for r in store.of_keys(rows([(7, "")])).collect()) == sorted(["a", *[f"k{k}" for k in range(MOST_VERSIONS + 3)]])
    assert max(len(v) for v, _ in store.manifest().values()) <= MOST_VERSIONS
    before = store.read().count()
    store.vacuum()
    assert store.read().count() == before and len(os.listdir(f"{fresh_dir}/s/manifest")) == 1
    assert BucketStore(spark, f"{fresh_dir}/s", schema, buckets=99).buckets == 4
    store.replace(rows([]), keys=spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint"))
    assert store.read().where("doc_id is not null").count() == 0


def test_folders_do_not_grow_with_documents(spark, fresh_dir):
    import os

    def write(n, to):
        catalog.write_analysis(spark.range(n).selectExpr("id as doc_id", "concat('d', id) as filename"), f"{fresh_dir}/{to}")
        return sum(len(d) for _, d, _ in os.walk(f"{fresh_dir}/{to}/data"))

    assert write(2000, "a") == write(400, "b") == 65
    assert catalog.read_analysis(spark, f"{fresh_dir}/a").count() == 2000


def test_saved_edits_are_appended_and_the_last_counts(spark, fresh_dir):
    log = lambda rows: spark.createDataFrame(rows, "doc_id long, edited_at long, edit_id long, payload string")
    catalog.save_edits(log([(1, 1, 1, "a"), (2, 1, 1, "b")]), f"{fresh_dir}/log")
    catalog.save_edits(log([(1, 2, 2, "c")]), f"{fresh_dir}/log")
    now = catalog.current_edits(spark.read.parquet(f"{fresh_dir}/log"))
    assert sorted(tuple(r) for r in now.collect()) == [(1, "c"), (2, "b")]


def test_a_document_waits_for_its_name(spark, fresh_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 4")
    sample_layout.layout_blocks(docs).write.parquet(f"{fresh_dir}/in")
    schema, none = "doc_id long, filename string, content_type string", spark.createDataFrame([], "filename string")
    rows = [(0, "a.pdf", "application/pdf"), (1, "b.txt", "text/plain"), (3, None, None)]
    analyze = lambda blocks: blocks.groupBy("doc_id").count().selectExpr("doc_id", "'x' as filename", "cast(count as int) as page_count")

    def run(rows):
        SJ.stream_documents(spark, f"{fresh_dir}/in", lambda: none, analyze, f"{fresh_dir}/out", f"{fresh_dir}/cp", names=lambda: spark.createDataFrame(rows, schema)).awaitTermination()
        return {r["doc_id"]: r["verdict"] for r in SJ.read_verdicts(spark, f"{fresh_dir}/out").collect()}

    assert run(rows) == {0: "admitted", 1: "rejected", 2: "unnamed", 3: "unnamed"}
    # No new file comes, only a name.
    assert run([*rows, (2, "c.pdf", "application/pdf"), (2, "z.pdf", "text/plain")]) == {0: "admitted", 1: "rejected", 2: "admitted", 3: "unnamed"}
    assert sorted(r[0] for r in catalog.read_analysis(spark, f"{fresh_dir}/out").select("doc_id").collect()) == [0, 2]


def test_display_order_takes_two_scans(spark, monkeypatch):
    from folioframe.operators import views

    calls, scan = [], scans.doc_scan
    monkeypatch.setattr(scans, "doc_scan", lambda *a, **k: calls.append(1) or scan(*a, **k))
    rows = spark.createDataFrame([(1, 0, 1, 0, "paragraph", False)], "doc_id long, span int, page int, ri int, role string, continuation boolean")
    assert views.sequence_floats(rows).count() == 1 and len(calls) == 2


def test_long_chains_and_long_formulas_take_linear_time(spark):
    import time

    from folioframe.operators import explain as E

    def took(n):
        rows = spark.range(n).selectExpr("1L as doc_id", "0 as span", "1 as page", "cast(id as int) as ri", "1 as chain", "concat('words of part ', id, case when id % 3 = 0 then '-' else '.' end) as text",
                                         "array(named_struct('text', concat('S ', id, '.'), 'boxes', array(named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D)))) as sentences",
                                         "cast(array() as array<struct<text:string>>) as footnotes")
        begin = time.time()
        out = E.merged_sentences(E.chain_payload(rows)).selectExpr("size(members)", "size(merged)", "length(text)", "members[1].offset").first()
        math = spark.range(1).selectExpr(f"repeat('a $x$ \\\\$ b', {n}) as t").select(F.size(E.tokenize_math(F.col("t")))).first()[0]
        assert out[0] == n and out[3] == 1 and math > n
        return time.time() - begin

    took(100)
    assert took(20_000) < 30 * max(0.5, took(2_000))


def test_a_document_of_removed_blocks_alone_has_no_verdict(spark, fresh_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 3")
    layout = sample_layout.layout_blocks(docs)
    gone = (F.col("doc_id") == 1) | ((F.col("doc_id") == 2) & (F.col("page") == 1))
    marked = layout.withColumn("removed", F.when(gone, True).otherwise(F.col("removed")))
    analyze = lambda blocks: blocks.groupBy("doc_id").count().selectExpr("doc_id", "'x' as filename", "cast(count as int) as page_count")

    def run():
        SJ.stream_documents(spark, f"{fresh_dir}/in", lambda: spark.createDataFrame([], "filename string"), analyze, f"{fresh_dir}/out", f"{fresh_dir}/cp").awaitTermination()
        return {r["doc_id"]: r["verdict"] for r in SJ.read_verdicts(spark, f"{fresh_dir}/out").collect()}

    marked.where("page = 1").write.parquet(f"{fresh_dir}/in")
    assert run() == {0: "admitted"}
    # What comes later is analysed with all that came before.
    more = marked.where("doc_id = 2 and page = 1").withColumns({"page": F.lit(99), "removed": F.lit(False)})
    more.write.mode("append").parquet(f"{fresh_dir}/in")
    assert run() == {0: "admitted", 2: "admitted"}
    counts = {r["doc_id"]: r["page_count"] for r in catalog.read_analysis(spark, f"{fresh_dir}/out").collect()}
    assert counts[2] == marked.where("doc_id = 2 and page = 1").count() * 2
