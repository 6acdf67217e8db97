"""What a reader walks through: stops, outline, the list of things to explain, and display order.

Rows come sorted by document and place inside each partition; the corpus is never sorted as a whole.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import scans

ORDER = ["page", "ri"]


def reading_sequence_pages(page_rows: DataFrame) -> DataFrame:
    """Stops of the page view: every box of every block and every image."""
    kind = F.when(F.col("kind") == "image", "i").otherwise("p")
    return page_rows.select("doc_id", "page", kind.alias("kind"), F.coalesce("ri", F.lit(0)).alias("ri"), *G.Box._fields).sortWithinPartitions(
        "doc_id", "page", "ri", "x0", "y0")


def reading_sequence_linear(linear: DataFrame) -> DataFrame:
    """Stops of the linear view; ``idx`` is the place among all linear blocks."""
    kind = F.when(F.col("role") == "paragraph", "p").when(F.col("role") == "title", "h").otherwise("i")
    return scans.dense_index(linear, ORDER, "idx").where(F.col("role").isin("title", "paragraph", "figure", "table")).select(
        "doc_id", "idx", kind.alias("kind"), "ri", "flat_block_ref").sortWithinPartitions("doc_id", "idx")


def section_outline(linear: DataFrame) -> DataFrame:
    number = F.regexp_extract("text", r"(?U)^\s*(\d+(?:\.\d+)*)", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return scans.dense_index(linear, ORDER, "idx").where((F.col("role") == "section_header") & (text != "")).select(
        "doc_id", "idx", text.alias("text"), F.least(F.lit(3), dots).alias("depth")).sortWithinPartitions("doc_id", "idx")


def chain_members(linear: DataFrame, payloads: DataFrame) -> DataFrame:
    """One entry per chain text and per figure, with the places of its members.

    Chains of equal text collapse into the first one.
    """
    rows = scans.dense_index(linear, ORDER, "idx")
    texts = rows.where("chain is not null").join(
        payloads.select("doc_id", "chain", F.col("text").alias("chain_text")), ["doc_id", "chain"])
    chains = (
        texts.groupBy("doc_id", F.col("chain_text").alias("text"))
        .agg(F.min(F.when(F.col("role") == "paragraph", F.col("idx"))).alias("idx"), F.array_sort(F.collect_list("idx")).alias("members"))
        .select("doc_id", "idx", F.lit("paragraph").alias("kind"), "text", "members")
    )
    figures = rows.where(F.col("role").isin("figure", "table", "algorithm")).select(
        "doc_id", "idx", F.lit("figure").alias("kind"), F.col("caption_text").alias("text"), F.array("idx").alias("members"))
    return chains.unionByName(figures).sortWithinPartitions("doc_id", "idx")


def sequence_floats(linear: DataFrame) -> DataFrame:
    """Display order that keeps merged paragraphs together: sort by (slot, rank, idx).

    What interrupts a chain moves behind its tail; boxed inserts move before its head; bridged
    equations stay. ``is_tail`` marks the last paragraph of a chain.
    """
    para = F.col("role") == "paragraph"
    rows = scans.doc_scan(
        linear, ORDER, idx=("sum", F.lit(1)), nxt=("next", F.when(para, F.col("continuation"))), seen=("last", F.when(para, F.lit(True))))
    rows = rows.withColumn("idx", F.col("idx").cast("int")).withColumn("goes_on", F.coalesce("nxt", F.lit(False)))
    # A chain is headed by a paragraph that goes on right after one that does not. The one before a paragraph goes on if this one continues it.
    head_here = para & F.col("goes_on") & ~(F.col("continuation") & F.col("seen").isNotNull())
    rows = scans.doc_scan(
        rows, ORDER, tail=("next", F.when(para & ~F.col("goes_on"), F.col("idx"))),
        done=("last", F.when(para & ~F.col("goes_on"), F.col("idx"))), head=("last", F.when(head_here, F.col("idx"))),
    )
    is_open = F.col("head").isNotNull() & (F.col("head") > F.coalesce("done", F.lit(-1)))
    bridged = (F.col("role") == "equation") & F.col("continuation")
    hoisted = ~para & ~bridged & (F.col("role") == "callout") & is_open & F.col("goes_on")
    deferred = ~para & ~bridged & ~hoisted & F.col("goes_on")
    slot = F.when(hoisted, F.col("head")).when(deferred, F.coalesce("tail", F.lit(2**31 - 1))).otherwise(F.col("idx"))
    rank = F.when(hoisted, -1).when(deferred, 1).otherwise(0)
    return rows.select(
        "doc_id", "page", "ri", "role", "idx", slot.alias("slot"), rank.alias("rank"),
        F.when(para, ~F.col("goes_on")).otherwise(F.lit(False)).alias("is_tail"),
    ).sortWithinPartitions("doc_id", "slot", "rank", "idx")
