"""Paragraphs that continue each other, the chains they form, and what is read from the chains."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import scans
from folioframe.operators.ordering import page_window
from folioframe.sources.layout import PAGE_KEY

ORDER = ["page", "ri"]


def _up():
    return page_window().orderBy("ri").rowsBetween(Window.unboundedPreceding, -1)


def _down():
    return page_window().orderBy("ri").rowsBetween(1, Window.unboundedFollowing)


def authors_after_title(rows: DataFrame) -> DataFrame:
    """Move masthead blocks right after the title, as authors, and renumber the documents that have any.

    Adds ``shelf``: rows of one page on different shelves are not neighbours in the new order.
    """
    place = F.struct("ri", "page")
    rows = scans.doc_scan(
        rows, ORDER, title=("total_min", F.when(F.col("role") == "title", place)), top=("total_min", place)
    )
    text, header = T.strip("text"), F.col("role") == "section_header"
    known = header & (T.is_body_section_name(text) | T.is_skip_section(text))
    prose = (F.col("role") == "paragraph") & (T.word_count("text") > 30) & ~T.is_dense_name_list("text")
    rows = rows.withColumn("title_page", F.coalesce("title.page", "top.page")).withColumn(
        "floor", F.min(F.when(known | prose, F.col("y0"))).over(page_window())
    )
    in_band = F.when(F.col("floor").isNotNull(), (F.col("y0") + F.col("y1")) / 2 < F.col("floor")).otherwise(
        T.looks_like_author_line(text) | T.is_soft_noise(text)
    )
    candidate = (F.col("role") == "author") | (
        (F.col("page") == F.col("title_page")) & F.col("role").isin("paragraph", "section_header") & (text != "")
        & ~known & in_band
    )
    before_title = F.coalesce(F.col("ri") <= F.col("title.ri"), F.lit(False))
    rows = rows.withColumn("part", F.when(candidate, 1).when(before_title, 0).otherwise(2))
    rows = rows.withColumns({
        "sort_y": F.when(F.col("part") == 1, F.col("y0")).otherwise(0.0),
        "sort_x": F.when(F.col("part") == 1, F.col("x0")).otherwise(0.0),
    })
    one = {k: F.when(F.col("part") == k, 1).otherwise(0) for k in (0, 1, 2)}
    kept = [c for c in rows.columns if c not in ("title", "top", "floor", "sort_y", "sort_x", "part")]
    rows = scans.doc_scan(
        rows, ["page", "sort_y", "sort_x", "ri"], r0=("sum", one[0]), r1=("sum", one[1]), r2=("sum", one[2]),
        n0=("total_sum", one[0]), n1=("total_sum", one[1]),
        away=("total_max", (F.col("part") == 1) & (F.col("page") != F.col("title_page"))),
    )
    moved = F.when(F.col("part") == 0, F.col("r0")).when(F.col("part") == 1, F.col("n0") + F.col("r1")).otherwise(
        F.col("n0") + F.col("n1") + F.col("r2")
    )
    shelf = F.when(F.col("away") & (F.col("part") == 2), 2).when(
        F.col("away") & (F.col("part") == 1) & (F.col("page") != F.col("title_page")), 1
    ).otherwise(0)
    out = {
        "role": F.when(F.col("part") == 1, "author").otherwise(F.col("role")),
        "ri": F.when(F.col("n1") > 0, moved).otherwise(F.col("ri")).cast("int"),
    }
    return rows.select(
        *[out[c].alias(c) if c in out else F.col(c) for c in kept if c != "title_page"], shelf.alias("shelf")
    )


def with_layout_type(rows: DataFrame) -> DataFrame:
    lo, hi = F.min("x0").over(page_window()), F.max("x1").over(page_window())
    return rows.withColumns({"min_x0": lo, "max_x1": hi}).withColumn(
        "layout_type", G.layout_type(G.box(), F.col("min_x0"), F.col("max_x1"))
    )


def _previous(extra: dict) -> F.Column:
    return F.when(F.col("is_para"), F.struct(
        F.col("page").alias("page"), *[F.col(c) for c in G.Box._fields], F.col("lh").alias("lh"),
        F.col("min_x0").alias("lo"), F.col("max_x1").alias("hi"), T.ends_unterminated("text").alias("open_end"),
        F.col("text").rlike(r"(?U)\S").alias("said"), *[v.alias(k) for k, v in extra.items()],
    ))


def _lexical(prev) -> F.Column:
    low = T.starts_lowercase(F.when(prev["said"], "x").otherwise(""), "text")
    return prev["said"] & (low | T.is_bullet("text") | prev["open_end"])


def _geometry(prev, covered) -> F.Column:
    return G.continuation_geometry_ok(
        G.box_of(prev), prev["page"], G.box(), F.col("page"), F.greatest(prev["lh"], F.col("lh")), covered,
        prev["lo"], prev["hi"], F.col("min_x0"), F.col("max_x1"),
    )


def _covered_between(rows: DataFrame, counts) -> DataFrame:
    """Add ``covered``: height of the gap to the previous paragraph of the page that blocks between fill.

    Each block between two paragraphs measures itself against both, so no pairs are formed.
    """
    mark = F.when(F.col("is_para"), F.struct(*G.Box._fields))
    rows = rows.withColumns({
        "p_up": F.last(mark, True).over(_up()), "p_down": F.first(mark, True).over(_down()),
        "gid": F.coalesce(F.sum(F.col("is_para").cast("int")).over(_up()), F.lit(0)),
    })
    fills = counts & ~F.col("is_para") & F.col("p_up").isNotNull() & F.col("p_down").isNotNull()
    cover = F.when(fills, G.gap_cover(G.box_of("p_up"), G.box_of("p_down"), G.box())).otherwise(0.0)
    group = Window.partitionBy(*PAGE_KEY, "gid")
    return rows.withColumn("cover", cover).withColumn("covered", F.sum("cover").over(group)).drop(
        "p_up", "p_down", "gid", "cover"
    )


def sentence_line_height(sentences="sentences") -> F.Column:
    boxes = F.flatten(F.transform(F.col(sentences), lambda s: s["boxes"]))
    return G.line_height(boxes)


def continuation_linear(rows: DataFrame) -> DataFrame:
    """Set ``continuation`` of linear paragraphs; rows need ``layout_type``, ``min_x0`` and ``max_x1``, and sentences or ``lh``, the line height of paragraphs."""
    rows = rows.withColumn("is_para", F.col("role") == "paragraph")
    if "lh" not in rows.columns:
        rows = rows.withColumn("lh", F.when(F.col("is_para"), sentence_line_height()).otherwise(0.0))
    rows = _covered_between(rows, F.lit(True))
    rows = scans.doc_scan(rows, ORDER, prev=("last", _previous({
        "layout_type": F.col("layout_type"), "note": T.is_table_note("role", "text")})))
    prev = F.col("prev")
    covered = F.when(prev["page"] == F.col("page"), F.col("covered")).otherwise(0.0)
    fires = (
        prev.isNotNull() & _lexical(prev) & _geometry(prev, covered)
        & G.layout_predecessor_ok(prev["layout_type"], "layout_type")
        & ~prev["note"] & ~T.is_table_note("role", "text")
    )
    return rows.withColumn(
        "continuation", F.when(F.col("is_para"), F.coalesce(fires, F.lit(False))).otherwise(F.col("continuation"))
    ).drop("is_para", "lh", "covered", "prev")


def continuation_pages(rows: DataFrame) -> DataFrame:
    """Set ``continuation`` of page paragraphs; every image of the page counts as something between."""
    lo, hi = F.min("x0").over(page_window()), F.max("x1").over(page_window())
    image = F.col("kind") == "image"
    rows = rows.withColumns({
        "min_x0": lo, "max_x1": hi, "is_para": (F.col("kind") == "block") & (F.col("role") == "paragraph"),
        "images": F.collect_list(F.when(image, F.struct(*G.Box._fields))).over(page_window()),
        "lh": F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")),
    })
    rows = _covered_between(rows, ~image)
    rows = scans.doc_scan(rows, ORDER, prev=("last", _previous({})))
    prev = F.col("prev")
    by_images = F.aggregate("images", F.lit(0.0), lambda a, i: a + G.gap_cover(G.box_of("prev"), G.box(), G.box_of(i)))
    covered = F.when(prev["page"] == F.col("page"), F.col("covered") + by_images).otherwise(0.0)
    fires = prev.isNotNull() & _lexical(prev) & _geometry(prev, covered)
    return rows.withColumn(
        "continuation", F.when(F.col("is_para"), F.coalesce(fires, F.lit(False))).otherwise(F.col("continuation"))
    ).drop("min_x0", "max_x1", "is_para", "images", "lh", "covered", "prev")


def bridge_display_math(rows: DataFrame, *lane: str) -> DataFrame:
    """A display equation right below an unfinished paragraph continues it; so does the paragraph below."""
    w = Window.partitionBy(*PAGE_KEY, *lane).orderBy("ri")
    near = F.struct(F.col("role").alias("role"), F.col("text").alias("text"), *[F.col(c) for c in G.Box._fields])
    equation = (F.col("role") == "equation") & (F.col("text") != "")
    if lane:
        equation = equation & (F.col("kind") == "block")
    above = F.col("above")
    joins = equation & (above["role"] == "paragraph") & T.ends_unterminated(above["text"]) & G.math_adjacent(
        G.box_of("above"), G.box()
    )
    follows = F.coalesce(F.lag("joins").over(w), F.lit(False)) & (F.col("role") == "paragraph") & G.math_adjacent(
        G.box_of("above"), G.box()
    )
    return (
        rows.withColumn("above", F.lag(near).over(w)).withColumn("joins", F.coalesce(joins, F.lit(False)))
        .withColumn("follows", F.coalesce(follows, F.lit(False)))
        .withColumn("continuation", F.col("continuation") | F.col("joins") | F.col("follows"))
        .drop("above", "joins", "follows")
    )


def clip_overlaps(rows: DataFrame) -> DataFrame:
    """Cut a block where the next block of its column begins. Cuts apply in reading order."""
    me = G.box()
    peers = F.collect_list(F.struct("ri", "shelf", "x0", "x1")).over(page_window())
    earlier = F.filter("peers", lambda p: (p["ri"] < F.col("ri")) & (p["shelf"] == F.col("shelf")) & G.x_overlaps(
        G.Box(p["x0"], None, p["x1"], None), me))
    cuts = F.array_sort(F.filter("aims", lambda a: (a["target"] == F.col("ri")) & (a["y0"] >= F.col("y0"))))
    cut = F.aggregate(cuts, F.col("y1"), lambda y1, c: F.when(y1 > c["y0"] + V.GEOM_TOL, c["y0"]).otherwise(y1))
    return (
        rows.withColumn("peers", peers)
        .withColumn("target", F.array_max(F.transform(earlier, lambda p: p["ri"])))
        .withColumn("aims", F.collect_list(F.when(F.col("target").isNotNull(), F.struct("ri", "target", "y0"))).over(page_window()))
        .withColumn("y1", cut).drop("peers", "target", "aims")
    )


# -- what is read from the chains ------------------------------------------------------------------------


def glue_groups(rows: DataFrame) -> DataFrame:
    """Add ``gid``: a new group begins at each block that does not continue."""
    return scans.doc_scan(rows, ORDER, inclusive=True, gid=("sum", (~F.col("continuation")).cast("int")))


def glued(texts) -> F.Column:
    """Texts of one group joined: a soft break at the end is taken off, else one space.

    The end of each text alone says how it meets the next one, so the parts are put together once. Only where a text in between is
    blank, or there is none, the joint depends on what came before, and the texts are joined one after another.
    """
    n = F.size(texts)
    inner = F.transform(F.slice(texts, 1, F.greatest(n - 1, F.lit(0))), T.rstrip)
    blank = F.exists(F.transform(texts, lambda t: F.coalesce(T.strip(t), F.lit(""))), lambda t: t == "")

    def part(t, i):
        begun = F.when(i == 0, t).otherwise(T.lstrip(t))
        return F.when(begun.rlike("[-—¬]$"), F.regexp_replace(begun, "[-—¬]$", "")).otherwise(F.concat(begun, F.lit(" ")))

    last = F.get(texts, n - 1)
    once = F.array_join(F.concat(F.transform(inner, part), F.array(F.when(n == 1, last).otherwise(T.lstrip(last)))), "")
    stepwise = F.aggregate(F.slice(texts, 2, F.greatest(n - 1, F.lit(0))), F.get(texts, F.lit(0)), T.join_hyphen)
    return F.when(blank | (n == 0), stepwise).otherwise(once)


def glued_paragraphs(page_blocks: DataFrame) -> DataFrame:
    """One row per glued paragraph: (doc_id, gid, text)."""
    return _glued(glue_groups(page_blocks))


def _glued(groups: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page", "ri", "text")))
    return groups.groupBy("doc_id", "gid").agg(ordered.alias("parts")).select("doc_id", "gid", glued(F.transform("parts", lambda p: p["text"])).alias("text"))


def full_text(page_blocks: DataFrame) -> DataFrame:
    """The text of each document; one value per document is what a document map is asked from."""
    ordered = F.array_sort(F.collect_list(F.struct("gid", "text")))
    # Dealt out by document once, ahead of both groupings.
    return _glued(glue_groups(page_blocks).select("doc_id", "gid", "page", "ri", "text").repartition("doc_id")).groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text")
    )


def chain_ids(rows: DataFrame) -> DataFrame:
    """Add ``chain``: paragraphs linked by ``continuation``, with bridged equations; other rows get null.

    ``allow_merges`` = false pins a paragraph alone; ``injected`` rows never chain.
    """
    pinned = ~F.coalesce(F.col("allow_merges"), F.lit(True))
    para = (F.col("role") == "paragraph") & ~F.col("injected")
    eq = (F.col("role") == "equation") & F.col("continuation") & ~F.col("injected")
    rows = rows.withColumns({"c_para": para, "c_eq": eq, "c_pin": para & pinned})
    rows = scans.doc_scan(rows, ORDER, c_open=("last", F.when(F.col("c_para"), ~F.col("c_pin"))))
    is_open = F.coalesce("c_open", F.lit(False))
    head = F.col("c_para") & (F.col("c_pin") | ~F.col("continuation") | ~is_open)
    rows = rows.withColumn("c_in", F.col("c_para") | (F.col("c_eq") & is_open)).withColumn("c_head", head)
    rows = scans.doc_scan(rows, ORDER, inclusive=True, chain=("sum", F.col("c_head").cast("int")))
    return rows.withColumn("chain", F.when(F.col("c_in"), F.col("chain").cast("int"))).drop(
        "c_para", "c_eq", "c_pin", "c_open", "c_in", "c_head"
    )
