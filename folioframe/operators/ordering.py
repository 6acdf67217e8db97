"""Reading order of a page and the context every block of the page is judged against."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import scans
from folioframe.sources.layout import PAGE_KEY, span_of

def page_window():
    return Window.partitionBy(*PAGE_KEY)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Add ``ord``: column-major order over all blocks of the page.

    Blocks that span the page divide it into zones; in a zone the left column is read before the right.
    """
    b, lo, hi = G.box(), F.min("x0").over(page_window()), F.max("x1").over(page_window())
    mid = F.col("page_lo") + (F.col("page_hi") - F.col("page_lo")) / 2
    right = b.x1 - F.greatest(b.x0, mid) > F.least(b.x1, mid) - b.x0
    down = page_window().orderBy("y0", "seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    barrier = G.spans_page(b, F.col("page_lo"), F.col("page_hi"))
    return (
        blocks.withColumns({"page_lo": lo, "page_hi": hi})
        .withColumn("lane", F.when(barrier, 2).when(right, 1).otherwise(0))
        .withColumn("zone", F.coalesce(F.sum((F.col("lane") == 2).cast("int")).over(down), F.lit(0)))
        .withColumn("ord", F.row_number().over(page_window().orderBy("zone", "lane", "y0", "seq", "part")) - 1)
        .drop("page_lo", "page_hi", "lane", "zone")
    )


def line_box(lines="lines") -> F.Column:
    return G.union_bbox(lines)


def joined_lines(lines="lines") -> F.Column:
    """The text of a block, as its lines make it."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def footnote_context(blocks: DataFrame) -> DataFrame:
    """Add ``lh``, ``body_lh`` and ``body_boxes``: what counts as body-size text on the page."""
    is_body = F.col("block_type").isin(V.BODY_TEXT_TYPES)
    heights = F.transform("lines", lambda x: x["y1"] - x["y0"])
    page_heights = F.flatten(F.collect_list(F.when(is_body, heights)).over(page_window()))
    body_size = is_body & (F.col("body_lh") > 0) & (F.col("lh") > 0) & (
        F.col("lh") >= V.FOOTNOTE_FONT_RATIO * F.col("body_lh")
    )
    return (
        blocks.withColumn("lh", G.upper_median(heights))
        .withColumn("body_lh", G.upper_median(page_heights))
        .withColumn("body_boxes", F.collect_list(F.when(body_size, line_box())).over(page_window()))
    )


def footnote_by_font(blocks: DataFrame) -> F.Column:
    """Smaller than body text, and nothing body-size below it in its column."""
    me = G.box()
    below = F.exists(
        "body_boxes", lambda o: (o["y0"] > me.y1 - V.GEOM_TOL) & G.x_overlaps(me, G.box_of(o))
    )
    small = (F.col("body_lh") > 0) & (F.col("lh") > 0) & (F.col("lh") <= V.FOOTNOTE_FONT_RATIO * F.col("body_lh"))
    return small & ~below


def rescue_footnotes(blocks: DataFrame) -> DataFrame:
    """Add ``rescued``: a tagged footnote with text lower down in its column is body text."""
    me = G.box()
    text_boxes = F.collect_list(
        F.when(F.col("block_type").isin(V.TEXT_TYPES), F.struct("x0", "y0", "x1", "y1"))
    ).over(page_window())
    lower = F.exists("text_boxes", lambda t: (t["y0"] > me.y0) & G.x_overlaps(me, G.box_of(t)))
    return (
        blocks.withColumn("text_boxes", text_boxes)
        .withColumn("rescued", (F.col("block_type") == "Footnote") & lower).drop("text_boxes")
    )


def has_abstract(blocks: DataFrame) -> F.Column:
    """Per block: an abstract heading in a header or text block of the first two pages."""
    return (
        (F.col("page") <= 2) & F.col("block_type").isin("SectionHeader", *V.TEXT_TYPES)
        & T.is_abstract_header("text")
    )


def documents_with_abstract(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.max(has_abstract(blocks)).alias("has_abstract"))


def page_bounds(rows: DataFrame, x0="x0", x1="x1") -> DataFrame:
    return rows.groupBy(*PAGE_KEY).agg(F.min(x0).alias("min_x0"), F.max(x1).alias("max_x1"))


# -- drawings --------------------------------------------------------------------------------------------


def callout_candidates(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles large enough for a boxed insert and shaded or stroked."""
    w, h = F.col("rect.x1") - F.col("rect.x0"), F.col("rect.y1") - F.col("rect.y0")
    page_area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    bordered = F.col("type").isin("s", "fs") & F.col("color").isNotNull()
    return (
        drawings.where((w >= V.CALLOUT_MIN_W) & (h >= V.CALLOUT_MIN_H) & (~G.is_whiteish("fill") | bordered))
        .join(pages, ["doc_id", "page"]).where(w * h <= V.CALLOUT_MAX_AREA * page_area)
        .select("doc_id", "page", *[F.round(f"rect.{c}", 2).alias(c) for c in G.Box._fields])
    )


def merge_callout_regions(candidates: DataFrame) -> DataFrame:
    """One row per page with ``regions``: each rectangle joins the first region it touches, not transitively."""
    box = "struct<y0:double,x0:double,x1:double,y1:double>"

    def touch(m, b):
        return ~((b["x1"] < m["x0"]) | (b["x0"] > m["x1"]) | (b["y1"] < m["y0"]) | (b["y0"] > m["y1"]))

    def step(acc, b):
        hit = F.array_position(F.transform(acc, lambda m: touch(m, b)), True)
        grown = F.transform(acc, lambda m, i: F.when(
            i == hit - 1,
            F.struct(
                F.least(m["y0"], b["y0"]).alias("y0"), F.least(m["x0"], b["x0"]).alias("x0"),
                F.greatest(m["x1"], b["x1"]).alias("x1"), F.greatest(m["y1"], b["y1"]).alias("y1"),
            )).otherwise(m))
        return F.when(hit > 0, grown).otherwise(F.concat(acc, F.array(b))).cast(f"array<{box}>")

    return candidates.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1"))).alias("boxes")
    ).select("doc_id", "page", F.aggregate("boxes", F.array().cast(f"array<{box}>"), step).alias("regions"))


def separator_candidates(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Thin wide rules low on the page."""
    w, h = F.col("rect.x1") - F.col("rect.x0"), F.col("rect.y1") - F.col("rect.y0")
    return (
        drawings.where(h <= V.SEPARATOR_MAX_HEIGHT).join(pages, ["doc_id", "page"])
        .where(
            (w >= V.SEPARATOR_MIN_WIDTH * F.greatest(F.lit(1.0), F.col("width")))
            & (F.col("rect.y0") >= V.SEPARATOR_BOTTOM * F.greatest(F.lit(1.0), F.col("height")))
        )
        .select("doc_id", "page", F.round("rect.y0", 2).alias("y"))
    )


def isolated_separator(candidates: DataFrame) -> DataFrame:
    """The topmost rule that stands alone; rules close together are the grid of a table."""
    w = Window.partitionBy("doc_id", "page").orderBy("y")
    far_up = F.coalesce(F.col("y") - F.lag("y").over(w) > V.SEPARATOR_CLUSTER_GAP, F.lit(True))
    far_down = F.coalesce(F.lead("y").over(w) - F.col("y") > V.SEPARATOR_CLUSTER_GAP, F.lit(True))
    return (
        candidates.withColumn("lone", far_up & far_down).where("lone")
        .groupBy("doc_id", "page").agg(F.min("y").alias("sep_y"))
    )


def with_drawings(blocks: DataFrame, drawings: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Add ``regions`` and ``sep_y`` of the page to each block."""
    if drawings is None:
        return blocks.withColumn("regions", F.lit(None).cast("array<struct<y0:double,x0:double,x1:double,y1:double>>")) \
            .withColumn("sep_y", F.lit(None).cast("double"))
    regions = merge_callout_regions(callout_candidates(drawings, pages))
    seps = isolated_separator(separator_candidates(drawings, pages))
    per_page = scans.by_span(regions.join(seps, ["doc_id", "page"], "full").withColumn("span", span_of("page")))
    return blocks.join(per_page, PAGE_KEY, "left")


def in_callout(regions="regions") -> F.Column:
    me = G.box()
    return F.coalesce(F.exists(regions, lambda r: G.inside_region(me, G.box_of(r))), F.lit(False))


def below_separator(y0="y0", sep_y="sep_y") -> F.Column:
    return F.coalesce(F.col(y0) >= F.col(sep_y) - V.GEOM_TOL, F.lit(False))


def flat_base(page_blocks: DataFrame) -> DataFrame:
    """Add ``flat``: running block number over the document."""
    return scans.dense_index(page_blocks, ["page", "ri"], "flat")
