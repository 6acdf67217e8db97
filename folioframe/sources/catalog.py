"""The store of documents: listing, admission, removal, edits; and the nested analysis files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe import schemas
from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.operators import scans
from folioframe.operators.edits import latest_edit
from folioframe.sources.layout import PAGE_KEY, span_of
from folioframe.sources.store import BUCKETS, BucketStore, write_tasks


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "modificationTime")


def document_catalog(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """PDF files, newest first, and whether each has an analysis."""
    flag = analyses.select("filename").distinct().withColumn("has_analysis", F.lit(True))
    return files.where(F.col("filename").endswith(".pdf")).join(flag, "filename", "left").select(
        "filename", F.col("length").alias("size_bytes"), F.coalesce("has_analysis", F.lit(False)).alias("has_analysis"),
        F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "filename")


def admit_documents(new: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Add ``verdict``: admitted, conflict (name taken), or rejected (not a PDF)."""
    known = existing.select("filename").distinct().withColumn("known", F.lit(True))
    taken = F.coalesce("known", F.lit(False)) & F.lit(not overwrite)
    return new.join(known, "filename", "left").withColumn("verdict", F.when(
        F.coalesce("content_type", F.lit("")) != "application/pdf", "rejected").when(taken, "conflict").otherwise("admitted")).drop("known")


def delete_documents(documents: DataFrame, analyses: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = names.select("filename").distinct()
    return documents.join(gone, "filename", "left_anti"), analyses.join(gone, "filename", "left_anti")


def has_native_text_layer(page_text: DataFrame) -> DataFrame:
    """Per document: every page has at least 50 characters, and there is a page."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    return page_text.groupBy("doc_id").agg(F.every(n >= V.NATIVE_TEXT_MIN_CHARS).alias("native"))


def page_density(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages per document (1 if none could be read) and megabytes per page."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(1))
    return files.join(n, "doc_id", "left").select(
        "doc_id", count.alias("page_count"), (F.col("length") / 1e6 / F.greatest(F.lit(1), count)).alias("mb_per_page"))


def current_edits(log: DataFrame) -> DataFrame:
    """Edits in force: the last payload a document was saved with, whole."""
    return latest_edit(log, ["doc_id"], ["payload"])


def save_edits(log: DataFrame, path: str) -> None:
    """Append to the edit log; ``current_edits`` is the view readers see."""
    log.write.mode("append").parquet(path)


# -- nested analysis -------------------------------------------------------------------------------------


def _box():
    return F.struct(*G.Box._fields)


def nest_analysis(pages: DataFrame, page_rows: DataFrame, linear: DataFrame, metadata: DataFrame, info: DataFrame) -> DataFrame:
    """One row per document in the exchange format. ``info``: doc_id, filename, global_map, language.

    Page parts are nested page by page first, so the last grouping handles one row per page, and linear rows by span. What has been nested moves to its document once, over the tasks
    that a store writes from.
    """
    n = write_tasks(linear.sparkSession)
    block = F.when(F.col("kind") == "block", F.struct(
        "text", F.array(_box()).alias("boxes"), "sentences", F.col("ri").alias("reading_index"), "continuation", "role", "footnotes"))
    image = F.when(F.col("kind") == "image", F.struct(
        _box().alias("bbox"), F.col("ri").alias("reading_index"), "role", "caption_text", "caption_bbox"))
    at = lambda c: F.struct(F.col("ri").alias("at"), c.alias("v"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), at(c)))), lambda x: x["v"])
    # Pages are put together where their rows lie, by span; only whole pages move to their documents.
    by_page = page_rows.groupBy(*PAGE_KEY).agg(ordered(block).alias("blocks"), ordered(image).alias("images"))
    left_out = metadata.groupBy(*PAGE_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "seq", "part", F.struct(_box().alias("bbox"), "text", "sentences", "source_type").alias("v")))), lambda x: x["v"]).alias("metadata_blocks"))
    empty = lambda c, t: F.coalesce(c, F.expr("array()").cast(f"array<{t}>")).alias(c)
    shown = scans.by_span(pages.withColumn("span", span_of("page")))
    nested = shown.join(by_page, PAGE_KEY, "left").join(left_out, PAGE_KEY, "left").select("doc_id", F.struct(
        "page", "width", "height", empty("blocks", schemas.PARAGRAPH), empty("images", schemas.IMAGE), empty("metadata_blocks", schemas.METADATA)).alias("p"))
    page_lists = nested.repartition(n, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    full = F.struct(
        "role", "text", "page", _box().alias("bbox"), F.col("ri").alias("reading_index"), "sentences", "flat_block_ref", "continuation",
        "caption_text", "caption_bbox", "footnotes", "layout_type")
    by_span = linear.groupBy("doc_id", "span").agg(F.collect_list(F.struct("ri", full.alias("v"))).alias("rows"))
    flow = by_span.repartition(n, "doc_id").groupBy("doc_id").agg(F.transform(F.array_sort(F.flatten(F.collect_list("rows"))), lambda x: x["v"]).alias("linear_blocks"))
    return page_lists.join(flow, "doc_id", "left").join(info, "doc_id").select(
        "doc_id", "filename", F.size("pages").alias("page_count"), "global_map", "pages",
        empty("linear_blocks", schemas.FULL_BLOCK), F.coalesce("language", F.lit(V.DEFAULT_LANGUAGE)).alias("language"))


def write_analysis(analysis: DataFrame, path: str, fmt: str = "json", buckets: int = BUCKETS) -> None:
    """Documents at hand replace those of the same doc_id, the others stay; see ``BucketStore``."""
    spark = analysis.sparkSession
    # An empty table that the optimizer takes away, so that rows stay where they lie.
    fields = T.StructType.fromDDL(schemas.ANALYSIS)
    none = spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    whole = none.unionByName(analysis, allowMissingColumns=True)
    BucketStore(spark, path, schemas.ANALYSIS, fmt=fmt, buckets=buckets).replace(whole)


def read_analysis(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested analyses from a store, or from a plain folder of files; old ones too: fields that older files lack get their defaults."""
    store = BucketStore(spark, path, schemas.ANALYSIS, fmt=fmt)
    raw = store.read() if store.seq else spark.read.schema(schemas.ANALYSIS).format(fmt).load(path)
    return raw.withColumn("language", F.coalesce("language", F.lit(V.DEFAULT_LANGUAGE))).withColumn(
        "linear_blocks", F.coalesce("linear_blocks", F.expr("array()").cast(f"array<{schemas.FULL_BLOCK}>")))


def flatten_analysis(analysis: DataFrame, keep: tuple = ()) -> dict:
    """The flat tables of nested analyses, with defaults for what is missing. Rows carry the columns ``keep`` of their document."""
    no_sent, no_notes = F.expr("array()").cast(f"array<{schemas.SENTENCE}>"), F.expr("array()").cast(f"array<{schemas.FOOTNOTE}>")
    p = analysis.select("doc_id", *keep, F.inline("pages")).withColumn("span", span_of("page"))
    box = lambda b: [F.col(f"{b}.{c}").alias(c) for c in G.Box._fields]
    blocks = p.select(*PAGE_KEY, *keep, F.explode("blocks").alias("b")).withColumn("u", G.union_bbox("b.boxes")).select(
        *PAGE_KEY, *keep, F.coalesce("b.reading_index", F.lit(0)).alias("ri"), F.lit("block").alias("kind"),
        F.coalesce("b.role", F.lit("paragraph")).alias("role"), F.coalesce("b.text", F.lit("")).alias("text"), *box("u"),
        F.coalesce("b.sentences", no_sent).alias("sentences"), F.coalesce("b.footnotes", no_notes).alias("footnotes"),
        F.coalesce("b.continuation", F.lit(False)).alias("continuation"), F.lit("").alias("caption_text"),
        F.lit(None).cast(schemas.BBOX).alias("caption_bbox"))
    images = p.select(*PAGE_KEY, *keep, F.explode("images").alias("b")).select(
        *PAGE_KEY, *keep, F.coalesce("b.reading_index", F.lit(0)).alias("ri"), F.lit("image").alias("kind"),
        F.coalesce("b.role", F.lit("figure")).alias("role"), F.lit("").alias("text"), *box("b.bbox"), no_sent.alias("sentences"),
        no_notes.alias("footnotes"), F.lit(False).alias("continuation"), F.coalesce("b.caption_text", F.lit("")).alias("caption_text"),
        F.col("b.caption_bbox").alias("caption_bbox"))
    linear = analysis.select("doc_id", *keep, F.explode("linear_blocks").alias("b")).select(
        "doc_id", *keep, F.col("b.page").alias("page"), F.col("b.reading_index").alias("ri"), F.col("b.role").alias("role"),
        F.coalesce("b.text", F.lit("")).alias("text"), *box("b.bbox"), F.coalesce("b.sentences", no_sent).alias("sentences"),
        F.coalesce("b.footnotes", no_notes).alias("footnotes"), F.coalesce("b.continuation", F.lit(False)).alias("continuation"),
        F.coalesce("b.caption_text", F.lit("")).alias("caption_text"), F.col("b.caption_bbox").alias("caption_bbox"),
        F.col("b.flat_block_ref").alias("flat_block_ref"), F.col("b.layout_type").alias("layout_type")).withColumn("span", span_of("page"))
    left_out = p.select(*PAGE_KEY, *keep, F.posexplode("metadata_blocks").alias("seq", "b")).select(
        *PAGE_KEY, *keep, "seq", F.coalesce("b.source_type", F.lit("")).alias("source_type"), F.coalesce("b.text", F.lit("")).alias("text"),
        *box("b.bbox"), F.coalesce("b.sentences", no_sent).alias("sentences"))
    return {"pages": p.select("doc_id", *keep, "page", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height")),
            "page_rows": blocks.unionByName(images), "linear": linear, "metadata": left_out}
