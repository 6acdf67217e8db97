"""The walk over a document: which block is kept, dropped, or a footnote, in both projections.

One pass over the blocks yields the page projection (``p_*`` columns) and the linear projection
(``l_*`` columns). Everything on a page is a window over the page; what runs through the document goes
through ``scans.doc_scan``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import ordering as O
from folioframe.operators import scans
from folioframe.operators.footnotes import attach_footnotes
from folioframe.operators.sentences import build_sentences
from folioframe.session import settle
from folioframe.sources.layout import PAGE_KEY

POS = ["page", "ord"]


def _before():
    return O.page_window().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def judge(blocks: DataFrame, drawings: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Order the page and judge every block by itself and by its page."""
    # The text follows from the lines, so only these move.
    b = scans.by_span(blocks.drop("text")).withColumn("text", O.joined_lines())
    b = O.with_drawings(O.rescue_footnotes(O.footnote_context(O.reading_order(b))), drawings, pages)
    latex = T.equation_latex("html")
    bt = F.when(F.col("rescued"), "Text").otherwise(F.col("block_type"))
    b = b.withColumn("bt", bt).withColumn("line_text", F.col("text")).withColumn(
        "text", F.when((F.col("bt") == "Equation") & (latex != ""), latex).otherwise(F.col("text"))
    )
    text, header, body = F.col("text"), F.col("bt") == "SectionHeader", F.col("bt").isin(V.BODY_TEXT_TYPES)
    is_text = F.col("bt").isin(V.TEXT_TYPES)
    named = header & (text != "")
    first = F.col("page") == 1
    own = body & ~F.col("rescued")
    small = O.footnote_by_font(b) | O.below_separator()
    note = own & (
        (small & ~T.is_caption_like(text) & ~T.is_source_line(text)) | T.strong_footnote_prefix(text)
    )
    tight = F.when(F.col("rescued") & (F.size("lines") > 0), O.line_box()).otherwise(F.struct("x0", "y0", "x1", "y1"))
    no = F.lit(False)
    flags = {
        "is_text": is_text,
        "is_image": F.col("bt").isin(V.IMAGE_TYPES),
        "h_named": named,
        "h_stop": F.when(named, T.is_stop_header(text)).otherwise(no),
        "h_skip": F.when(named, T.is_skip_section(text)).otherwise(no),
        "h_body": F.when(named, T.is_body_section_name(text)).otherwise(no),
        "h_abs": F.when(named, T.is_abstract_header(text)).otherwise(no),
        "t_skip": F.when(body, T.is_skip_section("line_text") | T.is_skip_section_inline("line_text")).otherwise(no),
        "t_solid": F.when(is_text, (T.word_count(text) >= 3) & ~(body & T.is_metadata_block("line_text"))).otherwise(no),
        "t_note": F.when(own, note).otherwise(no),
        "t_stop": F.when(is_text, T.is_stop_header(text)).otherwise(no),
        "t_license": F.when(is_text, T.is_license_noise(text)).otherwise(no),
        "t_hard": F.when(first & is_text, T.is_hard_noise(text)).otherwise(no),
        "t_contact": F.when(first & is_text, T.is_contact_block(text)).otherwise(no),
        "soft": F.when(first & (is_text | header), T.is_soft_noise(text)).otherwise(no),
        "author": F.when(first & (is_text | header), T.looks_like_author_line(text)).otherwise(no),
        "dense": F.when(first & is_text, T.is_dense_name_list(text)).otherwise(no),
        "abs_here": (F.col("page") <= 2) & (F.col("block_type") == "SectionHeader") & T.is_abstract_header("line_text")
        | (F.col("page") <= 2) & F.col("block_type").isin(V.TEXT_TYPES) & T.is_abstract_header("line_text"),
    }
    return b.withColumns(flags).withColumn("tight", tight).drop("body_boxes")


def skip_event() -> F.Column:
    """1 opens a skipped region, 0 closes it, null leaves it as it is."""
    return F.when(F.col("h_named") & ~F.col("h_stop"), F.col("h_skip").cast("int")).when(F.col("t_skip"), 1)


# What no rule after ``judge`` reads.
WIDE = ["lines", "text", "line_text", "html", "sup"]


def states(judged: DataFrame) -> DataFrame:
    """What runs along the document: skipped regions, the masthead, the title. The columns ``WIDE`` stay behind."""
    return _states(settle(judged.drop(*WIDE)))


def _states(settled: DataFrame) -> DataFrame:
    w = settled.withColumn("event", skip_event())
    w = scans.doc_scan(w, POS, has_abs=("total_max", F.col("abs_here")), l_skip=("last", F.col("event")))
    has_abs = F.col("has_abs")
    opens_body = F.col("h_named") & ~F.col("h_stop") & ~(has_abs & F.col("h_skip"))
    no = F.lit(False)
    return (
        w.withColumn("l_skip", has_abs & (F.coalesce("l_skip", F.lit(0)) == 1))
        .withColumn("p_skip", has_abs & (F.coalesce(F.last("event", True).over(_before()), F.lit(0)) == 1))
        .withColumn("heads", opens_body)
        .withColumn("masthead", (F.col("page") == 1) & has_abs & ~F.coalesce(
            F.max(F.col("heads") & F.col("h_body")).over(_before()), no))
        .withColumn("is_title", F.col("heads") & (F.col("page") == 1) & ~F.coalesce(F.max("heads").over(_before()), no))
    )


def walk(blocks: DataFrame, drawings: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Decide the fate of each block. Blocks are stored once, as judged; fates follow from slim columns and are joined to them by place."""
    # A text that its lines make is not stored beside them.
    other = F.when(F.col("text") != F.col("line_text"), F.col("text"))
    whole = settle(judge(blocks, drawings, pages).withColumn("text", other).drop("line_text"))
    whole = whole.withColumn("line_text", O.joined_lines()).withColumn("text", F.coalesce("text", "line_text"))
    w, has_abs = _states(whole.drop(*WIDE)), F.col("has_abs")
    for p in "pl":
        alive = F.col("is_text") & ~F.col(f"{p}_skip") & ~(has_abs & F.col("t_skip")) & F.col("t_solid")
        w = w.withColumn(f"{p}_alive", alive)
    pos = F.struct(*POS)
    stops = {
        f"{p}_stop": ("total_min", F.when(
            F.col("h_stop") | (F.col(f"{p}_alive") & ~F.col("t_note") & F.col("t_stop")), pos))
        for p in "pl"
    }
    abs_first = F.when(F.col("heads") & F.col("h_abs"), F.struct("page", "ord", "y0"))
    w = scans.doc_scan(w, POS, abs_hdr=("total_min", abs_first), **stops)
    place = [*PAGE_KEY, "ord"]
    fates = settle(_fates(w).select(*place, *FATES))
    return whole.drop(*GONE).join(fates, place)


FATES = ["has_abs", "p_kind", "p_role", "l_kind", "l_role0", "abs_top", "p_stop_page", "l_role"]
GONE = ["abs_here", "h_named", "h_stop", "h_skip", "h_body", "h_abs", "t_skip", "t_solid", "t_note", "t_stop", "t_license", "t_hard",
        "t_contact", "soft", "author", "dense", "regions", "sep_y", "is_text", "is_image"]


def _fates(w: DataFrame) -> DataFrame:
    pos = F.struct(*POS)
    for p in "pl":
        w = w.withColumn(f"{p}_live", F.col(f"{p}_stop").isNull() | (pos < F.col(f"{p}_stop")))
    tagged = F.col("bt") == "Footnote"
    masthead = F.col("masthead") & (F.col("soft") | F.col("author") | F.col("dense"))
    first = F.col("page") == 1
    text_role = T.text_role("bt")
    boxed = F.when(
        F.col("regions").isNotNull(), F.exists("regions", lambda r: G.inside_region(G.box_of("tight"), G.box_of(r)))
    ).otherwise(False)
    p_boxed = O.in_callout()
    kept = ~F.col("t_note") & ~F.col("t_stop") & ~F.col("t_license")
    p_noise = first & (F.col("t_hard") | F.col("t_contact") | masthead)
    l_author = first & (F.col("t_contact") | masthead)
    abs_valid = F.col("abs_hdr").isNotNull() & (
        F.col("l_stop").isNull() | (F.struct(F.col("abs_hdr.page"), F.col("abs_hdr.ord")) < F.col("l_stop"))
    )
    header_role = (
        F.when(F.col("is_title"), "title").when(F.col("h_body"), "section_header")
        .when(F.col("masthead") & (F.col("soft") | F.col("author")), "author").otherwise("section_header")
    )
    l_text_role = (
        F.when(l_author, "author").when((text_role == "paragraph") & boxed, "callout").otherwise(text_role)
    )
    return w.withColumn("p_kind", F.when(F.col("p_live"), F.when(tagged, "note").when(F.col("is_image"), "image").when(
        F.col("p_alive"), F.when(F.col("t_note"), "note").when(kept & ~p_noise, "block")))
    ).withColumn("p_role", F.when(F.col("p_kind") == "image", T.image_role("bt")).when(
        F.col("p_kind") == "block", F.when((text_role == "paragraph") & p_boxed, "callout").otherwise(text_role))
    ).withColumn("l_kind", F.when(F.col("l_live"), F.when(tagged, "note").when(F.col("heads"), "block").when(
        F.col("is_image"), "block").when(F.col("l_alive"), F.when(F.col("t_note"), "note").when(
            kept & ~(first & F.col("t_hard")), "block")))
    ).withColumn("l_role0", F.when(F.col("l_kind") == "block", F.when(F.col("h_named"), header_role).when(
        F.col("is_image"), T.image_role("bt")).otherwise(l_text_role))
    ).withColumn("abs_top", F.min(
        F.when(F.col("heads") & F.col("h_body") & F.col("h_abs") & F.col("p_live"), F.struct("ord", "y0"))
    ).over(O.page_window())["y0"]
    ).withColumn("p_stop_page", F.col("p_stop.page")
    ).withColumn("l_role", F.when(
        abs_valid & (F.col("l_role0") == "paragraph") & (F.col("page") == F.col("abs_hdr.page"))
        & (F.col("tight.y1") <= F.col("abs_hdr.y0") + 4), "author").otherwise(F.col("l_role0")))


# -- projections -----------------------------------------------------------------------------------------

NO_NOTES = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,marker:string,font_scale:double>>"
NO_SENTENCES = "array<struct<text:string,boxes:array<struct<x0:double,y0:double,x1:double,y1:double>>>>"
NO_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def empty(kind: str) -> F.Column:
    return F.expr("array()").cast(kind)


def page_rows(w: DataFrame, bare: bool = False) -> DataFrame:
    """Blocks and images of the page projection, numbered by ``ri`` on each page; ``bare`` leaves sentences and footnotes out."""
    emitted = F.col("p_kind").isin("block", "image")
    linked = w if bare else attach_footnotes(
        w, (F.col("p_kind") == "block") & (F.col("p_role") == "paragraph"), F.col("p_kind") == "note"
    )
    ri = F.coalesce(F.sum(emitted.cast("int")).over(_before()), F.lit(0)).cast("int")
    above = (F.col("p_kind") == "block") & F.col("abs_top").isNotNull() & (F.col("y1") <= F.col("abs_top") + 4)
    slim = [F.when(F.col("p_kind") == "block", F.col("text")).otherwise("").alias("text"), "x0", "y0", "x1", "y1"]
    rows = linked.withColumn("ri", ri).where(emitted & ~F.coalesce(above, F.lit(False)))
    if bare:
        return rows.select("doc_id", "span", "page", "ri", F.col("p_kind").alias("kind"), F.col("p_role").alias("role"), *slim)
    return (
        rows.select(
            "doc_id", "span", "page", "ri", F.col("p_kind").alias("kind"), F.col("p_role").alias("role"), *slim,
            F.when(F.col("p_kind") == "block", build_sentences()).otherwise(empty(NO_SENTENCES)).alias("sentences"),
            F.coalesce("footnotes", empty(NO_NOTES)).alias("footnotes"),
            F.lit(False).alias("continuation"), F.lit("").alias("caption_text"),
            F.lit(None).cast(NO_BOX).alias("caption_bbox"),
        )
    )


def linear_rows(w: DataFrame, bare: bool = False) -> DataFrame:
    """Blocks of the linear projection, numbered by ``ri`` through the document; ``bare`` leaves sentences and footnotes out."""
    emitted = F.col("l_kind") == "block"
    boxed = w.withColumns({f"l_{c}": F.col(f"tight.{c}") for c in G.Box._fields})
    linked = (boxed if bare else attach_footnotes(
        boxed, emitted & (F.col("l_role0") == "paragraph"), F.col("l_kind") == "note", prefix="l_",
    )).where(emitted)
    talks = F.col("l_role0").isin("paragraph", "equation")
    slim = [
        "doc_id", "span", "page", "ord", F.col("l_role").alias("role"),
        F.when(F.col("l_role0").isin("figure", "table"), "").otherwise(F.col("text")).alias("text"),
        *[F.col(f"l_{c}").alias(c) for c in G.Box._fields],
    ]
    if bare:
        return scans.dense_index(linked.select(*slim), POS, "ri")
    rows = linked.select(
        *slim,
        F.when(talks, build_sentences()).otherwise(empty(NO_SENTENCES)).alias("sentences"),
        F.coalesce("footnotes", empty(NO_NOTES)).alias("footnotes"),
        F.lit(False).alias("continuation"), F.lit("").alias("caption_text"),
        F.lit(None).cast(NO_BOX).alias("caption_bbox"),
    )
    return scans.dense_index(rows, POS, "ri")


def emitted_pages(w: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the page projection: those up to the one where the document stops."""
    stops = w.groupBy("doc_id").agg(F.min("p_stop_page").alias("stop")).where("stop is not null")
    return (
        pages.join(stops, "doc_id", "left").where("stop is null or page <= stop")
        .select("doc_id", "page", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"))
    )
