"""A corpus from documents to packed batches: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import prepare, stage
from folioframe.llm.exact_dedup import exact_duplicates, keep_rows
from folioframe.llm.language import identify, learn_languages
from folioframe.llm.mixing import mix
from folioframe.llm.near_dedup import near_classes
from folioframe.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; what the classifier rejects goes, as does a text that is null or has no letter."""
    prepare(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return identify(rows, learn_languages(docs), ["row"]).where("not rejected").select("row.*")


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    prepare(spark)
    return keep_rows(docs, exact_duplicates(docs).where("kept"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    return keep_rows(docs, near_classes(docs).where("kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its copies say, perhaps not at all."""
    prepare(spark)
    found = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("copies > 0")
    copies = found.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in batches of near-equal lengths."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("exact dedup", one_of_equal),
    ("near dedup", one_of_near),
    ("mixing", mixed),
    ("packing", packed),
]

# Classifiers, sketches and dynamic programming have no SQL; tests compare the stages with direct versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written once and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
