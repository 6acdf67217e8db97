"""Linking symbol footnotes to the paragraphs that cite them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators.ordering import page_window


def footnote_font_scale(lh="lh", body_lh="body_lh") -> F.Column:
    lh, body = F.col(lh), F.col(body_lh)
    known = (lh > 0) & (body > 0)
    ratio = body / F.when(known, lh)
    return F.when(known, F.greatest(F.lit(1.0), F.least(F.lit(2.0), ratio))).otherwise(1.0)


def attach_footnotes(rows: DataFrame, is_host, is_note, note_text="text", prefix: str = "") -> DataFrame:
    """Add ``footnotes`` to host rows; rows need ``ord``, ``sup``, ``lines``, ``lh`` and ``body_lh``.

    Only paragraphs that show a footnote symbol can be hosts, so the page list each note looks through is
    short. The nearest earlier paragraph with the symbol as superscript wins; else the only one with it
    in its text; else, for symbols that mean nothing but a footnote, the nearest one above in the column.
    """
    host_box = G.box(prefix)
    may_host = is_host & (T.has_footnote_symbol("text") | (F.size("sup") > 0))
    hosts = F.collect_list(F.when(may_host, F.struct(
        F.col("ord").alias("ord"), F.col("text").alias("text"), F.col("sup").alias("sup"),
        *[getattr(host_box, c).alias(c) for c in G.Box._fields],
    ))).over(page_window())
    sym = T.leading_footnote_symbol(note_text)
    whole = F.when(F.size("lines") > 0, G.union_bbox("lines")).otherwise(F.struct("x0", "y0", "x1", "y1"))
    note_box = F.when(F.col("block_type") == "Footnote", whole).otherwise(F.struct("x0", "y0", "x1", "y1"))

    earlier = F.filter("hosts", lambda h: h["ord"] < F.col("ord"))
    marked = F.filter("earlier", lambda h: F.array_contains(h["sup"], F.col("sym")))
    hits = F.filter("earlier", lambda h: F.contains(h["text"], F.col("sym")))
    above = F.filter("hits", lambda h: (h["y0"] < F.col("note_box.y0")) & G.x_overlaps(G.box_of(h), G.box_of("note_box")))
    plain = (F.length("sym") >= 2) | F.col("sym").isin(*V.STRONG_FOOTNOTE_SYMBOLS)
    nearest = F.array_max(F.transform(above, lambda h: F.struct(h["y0"].alias("y"), (-h["ord"]).alias("o"))))
    host = F.when(F.col("sym") != "", F.coalesce(
        F.array_max(F.transform(marked, lambda h: h["ord"])),
        F.when(F.size("hits") == 1, F.get(F.transform("hits", lambda h: h["ord"]), F.lit(0))),
        F.when((F.size("hits") > 1) & plain, -nearest["o"]),
    ))
    note = F.struct(
        F.col("host").alias("host"), F.col("ord").alias("ord"), F.col(note_text).alias("text"),
        F.col("note_box").alias("bbox"), F.col("sym").alias("marker"), footnote_font_scale().alias("font_scale"),
    )
    scratch = ["hosts", "sym", "note_box", "earlier", "hits", "host", "notes"]
    linked = (
        rows.withColumn("hosts", hosts)
        .withColumns({"sym": F.when(is_note, sym), "note_box": F.when(is_note, note_box)})
        .withColumn("earlier", F.when(F.col("sym") != "", earlier))
        .withColumn("hits", hits).withColumn("host", host)
        .withColumn("notes", F.collect_list(F.when(F.col("host").isNotNull(), note)).over(page_window()))
    )
    mine = F.filter("notes", lambda n: n["host"] == F.col("ord"))
    tidy = F.transform(F.array_sort(F.transform(mine, lambda n: F.struct(
        n["ord"].alias("ord"), n["text"].alias("text"), n["bbox"].alias("bbox"), n["marker"].alias("marker"),
        n["font_scale"].alias("font_scale")))), lambda n: F.struct(n["text"], n["bbox"], n["marker"], n["font_scale"]))
    return linked.withColumn("footnotes", F.when(may_host, tidy)).drop(*scratch)
