"""Text the reading flow left out, and links between the two projections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.operators import scans
from folioframe.operators.ordering import flat_base, line_box
from folioframe.operators.sentences import build_sentences
from folioframe.sources import layout
from folioframe.sources.layout import PAGE_KEY


def emitted_boxes(page_rows: DataFrame, linear: DataFrame) -> DataFrame:
    """Every box of blocks, images, captions and footnotes of both projections."""
    def of(rows):
        notes = F.transform("footnotes", lambda n: n["bbox"])
        caption = F.when((F.col("kind") == "image") & F.col("caption_bbox").isNotNull(), F.array("caption_bbox")) \
            if "kind" in rows.columns else F.lit(None)
        extra = F.coalesce(caption.cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), F.slice(notes, 1, 0))
        return rows.select(*PAGE_KEY, F.inline(F.concat(F.array(F.struct(*G.Box._fields)), notes, extra)))

    return of(page_rows).unionByName(of(linear))


def metadata_candidates(blocks: DataFrame) -> DataFrame:
    """Text blocks of any type but images and groups, at their line extent."""
    return (
        blocks.where(~F.col("block_type").isin(*V.IMAGE_TYPES, *V.GROUP_TYPES) & (F.size("lines") > 0))
        .withColumn("lb", line_box())
        .select(*PAGE_KEY, "seq", "part", "block_type", "line_text", "lines", *[F.col(f"lb.{c}").alias(c) for c in G.Box._fields])
    )


def metadata_subtract(candidates: DataFrame, emitted: DataFrame) -> DataFrame:
    """Candidates no emitted box of the page covers."""
    c, e = candidates.alias("c"), emitted.alias("e")
    on_page = [F.col(f"c.{k}") == F.col(f"e.{k}") for k in PAGE_KEY]
    cond = G.same_object(G.box("c."), G.box("e."))
    for k in on_page:
        cond = k & cond
    return c.join(e, cond, "left_anti")


def metadata_self_dedup(rows: DataFrame) -> DataFrame:
    """Of candidates that cover each other, the first in model order stays."""
    fields = ["seq", "part"] + [c for c in rows.columns if c not in (*PAGE_KEY, "seq", "part")]
    g = rows.groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("arr"))
    acc_type = g.schema["arr"].dataType.simpleString()

    def step(acc, r):
        seen = F.exists(acc, lambda a: G.same_object(G.box_of(a), G.box_of(r)))
        return F.when(seen, acc).otherwise(F.concat(acc, F.array(r))).cast(acc_type)

    return g.select(*PAGE_KEY, F.inline(F.aggregate("arr", F.expr("array()").cast(acc_type), step)))


def metadata_blocks(blocks: DataFrame, page_rows: DataFrame, linear: DataFrame, pages: DataFrame) -> DataFrame:
    kept = metadata_self_dedup(metadata_subtract(metadata_candidates(blocks), emitted_boxes(page_rows, linear)))
    shown = scans.by_span(pages.select("doc_id", "page", layout.span_of("page").alias("span")))
    return kept.join(shown, PAGE_KEY, "left_semi").select(
        *PAGE_KEY, "seq", "part", F.col("block_type").alias("source_type"), F.col("line_text").alias("text"),
        *G.Box._fields, build_sentences("line_text").alias("sentences"),
    )


def flat_block_refs(linear: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Add ``flat_block_ref``: number of the page block at exactly the box of a linear paragraph."""
    key = [*PAGE_KEY, *G.Box._fields]
    flat = flat_base(page_rows.where("kind = 'block'")).groupBy(*key).agg(F.max("flat").alias("flat_block_ref"))
    keyed = linear.where("role = 'paragraph'").join(flat, key, "left")
    rest = linear.where("role <> 'paragraph'").withColumn("flat_block_ref", F.lit(None).cast("int"))
    return keyed.select(rest.columns).unionByName(rest)
