"""What is written on the way: settled tables, the store of analyses, and the tasks documents are dealt to."""

import glob
import os

from pyspark.sql import functions as F

from checks import registry
from folioframe.session import settle, shared_folder
from folioframe.sources import sample_layout, store
from folioframe.sources.store import BucketStore
from folioframe.streaming import jobs


def _bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f))


def test_settled_tables_are_packed_columns(spark):
    folder = shared_folder(spark)
    before = set(glob.glob(f"{folder}/settled-*"))
    out = settle(spark.range(50000).select("id", F.repeat(F.lit("some words "), 20).alias("text"), F.array(F.struct(F.lit(1.5).alias("x"))).alias("boxes")))
    new = set(glob.glob(f"{folder}/settled-*")) - before
    assert out.count() == 50000 and len(new) == 1 and _bytes(new.pop()) < 1 << 20
    assert settle(spark.range(3).withColumn("nothing", F.lit(None))).count() == 3


def test_json_store_is_packed_and_replaces(spark, fresh_dir):
    store = BucketStore(spark, f"{fresh_dir}/s", "doc_id bigint, text string", fmt="json", buckets=4)
    rows = lambda lo, hi, t: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.repeat(F.lit(t), 100).alias("text"))
    store.replace(rows(0, 2000, "first words "))
    store.replace(rows(1500, 2500, "other words "))
    store.replace(rows(0, 0, ""), rows(0, 10, "").select("doc_id"))
    files = [f for f in glob.glob(f"{fresh_dir}/s/data/**/part-*", recursive=True)]
    assert files and all(f.endswith(".json.gz") for f in files) and _bytes(f"{fresh_dir}/s/data") < 1 << 20
    got = {r["doc_id"]: r["text"][:5] for r in store.read().collect()}
    assert sorted(got) == list(range(10, 2500)) and got[1499] == "first" and got[1500] == "other"


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    size = registry.table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(registry, "TASK_BYTES", size // 100)
    assert 100 <= registry.documents(spark, sf).rdd.getNumPartitions() <= 102


def test_replace_stores_rows_once(spark, fresh_dir, monkeypatch):
    stored, computed = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(store, "settle", lambda df: stored.append(df.columns) or settle(df))
    made = BucketStore(spark, f"{fresh_dir}/s", "doc_id bigint, text string", fmt="json", buckets=4)

    def counted(x):
        computed.add(1)
        return x

    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.udf(counted, "string")(F.col("id").cast("string")).alias("text"))
    made.replace(rows)
    made.replace(rows.where("doc_id >= 900"))
    assert computed.value == 1100 and all(c == ["doc_id"] for c in stored)
    assert sorted((r.doc_id, r.text) for r in made.read().collect()) == [(i, str(i)) for i in range(1000)]


def test_rows_that_lie_by_key_are_written_where_they_are(spark, fresh_dir):
    made = BucketStore(spark, f"{fresh_dir}/s", "doc_id bigint, text string", buckets=4)
    n = store.write_tasks(spark, 4)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    made.replace(rows)
    files = glob.glob(f"{fresh_dir}/s/data/*/bucket=*/part-*")
    assert len(files) == n and made.read().count() == 4000
    lying = rows.repartition(n, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    plan = made._dealt(lying.select("doc_id", "text", made._bucket().alias("bucket")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_store_of_an_older_hash_keeps_it(spark, fresh_dir):
    old = BucketStore(spark, f"{fresh_dir}/s", "doc_id bigint, text string", buckets=4)
    old.hash = "xxhash64"
    old.replace(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("old").alias("text")))
    spark.read.json(f"{fresh_dir}/s/manifest/seq=1").drop("hash").write.json(f"{fresh_dir}/s/manifest/seq=2")
    now = BucketStore(spark, f"{fresh_dir}/s", "doc_id bigint, text string")
    now.replace(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("new").alias("text")))
    assert {(r.text, r.n) for r in now.read().groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()} == {("old", 50), ("new", 50)}
    assert now.of_keys(spark.range(60, 70).select(F.col("id").alias("doc_id"))).count() == 10


def test_arriving_rows_are_stored_once(spark, fresh_dir, monkeypatch):
    stored = []
    for module in (jobs, store):
        monkeypatch.setattr(module, "settle", lambda df: stored.append(df.columns) or settle(df))
    docs = spark.createDataFrame([(1, "Some words.\nMore of them."), (2, "Other words.")], "doc_id long, text string")
    sample_layout.layout_blocks(docs).write.parquet(f"{fresh_dir}/in")
    known = spark.createDataFrame([("doc1.pdf",), ("doc2.pdf",)], "filename string")
    jobs.stream_documents(spark, f"{fresh_dir}/in", lambda: known, lambda blocks: None, f"{fresh_dir}/out", f"{fresh_dir}/cp").awaitTermination()
    assert {(r.doc_id, r.verdict) for r in jobs.read_verdicts(spark, f"{fresh_dir}/out").collect()} == {(1, "conflict"), (2, "conflict")}
    assert stored and not [c for c in stored if "lines" in c]
