"""Registered queries and the SQL each must agree with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import scans
from folioframe.session import plan_tasks, settle, tune
from folioframe.sources import sample_layout
from folioframe.sources.layout import read_layout

QUERIES: dict = {}
ORACLES: dict = {}


def check(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the SQL it is compared with, where SQL can say it."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def shared(fn):
    """Settled input of several queries, derived once per session and data folder."""
    held: dict = {}

    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in held:
            held[key] = fn(spark, sf_dir)
        return held[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over all cores, however few files they come in, and over as many tasks as their texts need: some 16 MB each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartition(_plan(spark, docs), "doc_id")


def documents_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where their files lie; later steps have as many tasks as their texts need."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _plan(spark, docs)
    return docs


def _plan(spark: SparkSession, docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return plan_tasks(spark, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


@shared
def bronze(spark: SparkSession, sf_dir: str) -> dict:
    """Layout tables of the documents. Blocks are made where the walk reads them, once a query, and stored by it as judged."""
    docs = documents(spark, sf_dir)
    tables = sample_layout.bronze(docs) | page_tables(spark, sf_dir)
    tables.pop("recognized_lines")
    return tables


def page_tables(spark: SparkSession, sf_dir: str) -> dict:
    """Pages and drawings, which only follow from the number of lines of a text: made where the documents are read, so no text moves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return {"layout_pages": sample_layout.layout_pages(docs), "drawings": sample_layout.drawings(docs)}


@shared
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents. Their lines are dealt out by ``(doc_id, span)`` as documents are, so no block moves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _plan(spark, docs)
    return settle(read_layout(sample_layout.layout_blocks(scans.by_span(sample_layout.stretches(docs)))))
