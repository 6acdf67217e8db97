"""Layout tables derived from a table of plain documents, for checks and measurements.

Plain text has no geometry, so every non-empty line of a document becomes one layout block whose type,
place and wording follow from integer arithmetic on ``doc_id`` and the line number. The work grows with
the documents and every character of them is used.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.functions.arrays import let
from folioframe.sources import layout

# Block type by code, eight blocks a page.
TYPES = [
    "SectionHeader", "Caption", "Figure", "Table", "Footnote", "PageHeader", "Equation", "ListItem", "Code",
    "Reference", "Text", "Text", "Text", "Text", "Text", "TextInlineMath",
]


PER_PAGE = 8


def stretches(documents: DataFrame) -> DataFrame:
    """The lines of a document, one row per span: dealt out by ``(doc_id, span)``, texts move once and the blocks are made where they stay."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    size = PER_PAGE * layout.SPAN_PAGES

    def cut(lines):
        spans = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
        return F.when(F.size(lines) > 0, F.transform(spans, lambda k: F.slice(lines, k * size + 1, size)))

    return documents.select("doc_id", F.posexplode(let(F.filter(trimmed, lambda x: x != ""), cut)).alias("span", "lines"))


def _pieces(documents: DataFrame) -> DataFrame:
    parts = documents if "lines" in documents.columns else stretches(documents)
    return parts.select("doc_id", "span", F.posexplode("lines").alias("k", "raw")).select(
        "doc_id", "span", (F.col("span") * PER_PAGE * layout.SPAN_PAGES + F.col("k")).alias("i"), "raw")


def block_plan(documents: DataFrame) -> DataFrame:
    """One row per block: type, wording and box, before lines are built. ``documents``: doc_id and text, or their ``stretches``."""
    i, d, raw = F.col("i"), F.col("doc_id"), F.col("raw")
    kind = F.when(i == 0, "SectionHeader").otherwise(
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((d * 7 + i * 5) % 16 + 1).cast("int"))
    )
    header = F.when((i >= 12) & ((d + i) % 5 == 4), "References").otherwise(
        F.element_at(
            F.array(F.lit("Abstract"), F.lit("1 Introduction"), F.lit("Keywords"), F.lit("2.1 Methods")),
            ((d + i) % 4 + 1).cast("int"),
        )
    )
    caption = F.when(i % 2 == 0, F.concat(F.lit("Figure "), i, F.lit(": "), raw)).otherwise(
        F.concat(F.lit("Table "), i, F.lit(". "), raw)
    )
    v = (d + 3 * i) % 19
    worded = (
        F.when(v == 0, F.concat(F.lit("†† "), raw)).when(v == 1, F.concat(F.lit("Note. "), raw))
        .when(v == 2, F.lower(raw)).when(v == 3, F.concat(F.lit("• "), raw))
        .when(v == 4, F.concat(F.lit("Source: "), raw)).when(v == 5, F.concat(raw, F.lit(" and †")))
        .when(v == 6, F.concat(raw, F.lit(" a@b.org c@d.org")))
        .when(v == 7, F.concat(F.lit("Algorithm "), i, F.lit(" "), raw))
        .when(v == 8, F.concat(F.lit("(b) "), raw)).when(v == 9, F.concat(F.lit("Algorithm "), i, F.lit(" :")))
        .when(v == 10, F.regexp_replace(raw, "[.!?]+$", ""))
        .when((v == 11) & (i % 3 == 0), F.concat(F.lit("Keywords: "), raw))
        .when(v == 12, F.concat(F.lit("a. "), raw)).otherwise(raw)
    )
    text = (
        F.when(F.col("block_type") == "SectionHeader", header).when(F.col("block_type") == "Caption", caption)
        .when(F.col("block_type").isin("Figure", "Table"), "")
        .when(F.col("block_type") == "Footnote", F.concat(F.lit("† "), raw)).otherwise(worded)
    )
    slot = F.col("slot")
    return (
        _pieces(documents)
        .withColumn("page", (F.floor(i / PER_PAGE) + 1).cast("int")).withColumn("slot", (i % PER_PAGE).cast("int"))
        .withColumn("seq", ((slot * 5 + d) % 8).cast("int")).withColumn("block_type", kind)
        .withColumn("text", text)
        .withColumn("x0", F.when(slot.between(4, 6), 310.0).otherwise(50.0))
        .withColumn("x1", F.when(slot.between(1, 3), 290.0).otherwise(550.0))
        .withColumn(
            "y0",
            F.when(slot == 0, 60).when(slot == 7, 680).when(slot <= 3, 160 + 170 * (slot - 1))
            .otherwise(160 + 170 * (slot - 4)).cast("double"),
        )
        .withColumn("h", F.when((F.col("block_type") == "Footnote") | ((d + i) % 13 == 0), 7).otherwise(10))
        .withColumn("words", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ")))
        .withColumn("per_line", F.greatest(F.lit(8), F.floor((F.size("words") + 11) / 12).cast("int")))
        .withColumn("n_lines", F.ceil(F.size("words") / F.col("per_line")).cast("int"))
        .withColumn(
            "y1",
            F.col("y0") + F.when(F.col("block_type").isin("Figure", "Table"), 120.0).otherwise(
                12.0 * F.greatest(F.lit(1), F.col("n_lines"))
            ),
        )
    )


def layout_blocks(documents: DataFrame) -> DataFrame:
    """The layout table; blocks of ``stretches`` keep their span."""
    p = block_plan(documents)
    d, i = F.col("doc_id"), F.col("i")

    def line(j):
        text = F.array_join(F.slice("words", j * F.col("per_line") + 1, F.col("per_line")), " ")
        top = F.col("y0") + 12.0 * j
        bbox = F.struct(F.col("x0").alias("x0"), top.alias("y0"), F.col("x1").alias("x1"), (top + F.col("h")).alias("y1"))
        math = (F.col("block_type") == "TextInlineMath") & (j % 2 == 0)
        marked = (j == F.col("n_lines") - 1) & F.col("text").endswith(" and †") & (d % 2 == 0)
        no_html = F.lit(None).cast("string")
        plain = F.when(marked, F.regexp_replace(text, "†$", "")).otherwise(text)
        body = F.struct(
            plain.alias("text"), F.lit(False).alias("superscript"), math.alias("math"),
            F.when(math, F.concat(F.lit("<math>"), F.lower(plain), F.lit("</math>"))).otherwise(no_html).alias("html"),
        )
        dagger = F.struct(
            F.lit("†").alias("text"), F.lit(True).alias("superscript"), F.lit(False).alias("math"), no_html.alias("html")
        )
        spans = F.when(marked, F.array(body, dagger)).otherwise(F.array(body))
        return F.struct(text.alias("text"), bbox.alias("bbox"), ((j > 0) & ((d + j) % 31 == 0)).alias("removed"), spans.alias("spans"))

    indices = F.when(F.col("n_lines") > 0, F.sequence(F.lit(0), F.col("n_lines") - 1)).otherwise(F.array().cast("array<int>"))
    bbox = F.struct("x0", "y0", "x1", "y1")
    html = F.when(
        (F.col("block_type") == "Equation") & (d % 3 != 0),
        F.concat(F.lit('<math display="block">'), F.col("raw"), F.lit("</math>")),
    ).otherwise(F.lit(None).cast("string"))
    none = F.expr("array()").cast(f"array<{schemas.LINE}>")
    children = F.array(
        F.struct(F.lit("Table").alias("block_type"), F.lit(False).alias("removed"), bbox.alias("bbox"),
                 F.lit(None).cast("string").alias("html"), none.alias("lines")),
        F.struct(F.lit("Caption").alias("block_type"), F.lit(True).alias("removed"), bbox.alias("bbox"),
                 F.lit(None).cast("string").alias("html"), none.alias("lines")),
    )
    grouped = (F.col("block_type") == "Table") & (i % 2 == 0)
    return p.select(
        "doc_id", *(["span"] if "lines" in documents.columns else []), "page", "seq", F.when(grouped, "TableGroup").otherwise(F.col("block_type")).alias("block_type"),
        ((d * 3 + i) % 29 == 0).alias("removed"), bbox.alias("bbox"), html.alias("html"),
        F.transform(indices, line).alias("lines"),
        F.when(grouped, children).otherwise(F.lit(None)).cast(f"array<{schemas.CHILD}>").alias("children"),
    )


def layout_pages(documents: DataFrame) -> DataFrame:
    """One row per page, straight from the number of pieces of a document: no shuffle."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    n = F.size(F.filter(trimmed, lambda x: x != ""))
    return (
        documents.select("doc_id", n.alias("n")).where("n > 0")
        .select("doc_id", F.explode(F.sequence(F.lit(1), F.floor((F.col("n") - 1) / 8).cast("int") + 1)).alias("page"))
        .select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    )


def drawings(documents: DataFrame) -> DataFrame:
    d, p = F.col("doc_id"), F.col("page")
    none = F.lit(None).cast("array<double>")
    black, grey, white = [F.array(*[F.lit(v)] * 3) for v in (0.0, 0.9, 1.0)]

    def drawing(x0, y0, x1, y1, kind, fill, color):
        rect = F.struct(*[F.lit(float(v)).alias(c) for v, c in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])
        return F.struct(rect.alias("rect"), F.lit(kind).alias("type"), fill.alias("fill"), color.alias("color"))

    rule = lambda y: drawing(50, y, 300, y + 1, "s", none, black)
    every = F.array(drawing(0, 0, 600, 800, "f", white, none))
    some = [
        ((d + p) % 3 == 0, F.array(rule(660))),
        ((d + p) % 3 == 1, F.array(rule(600), rule(630), rule(674))),
        (d % 4 == 0, F.array(drawing(50, 330, 290, 480, "f", grey, none))),
        (d % 8 == 0, F.array(drawing(45, 400, 295, 500, "s", none, black), drawing(320, 150, 340, 600, "s", none, black))),
    ]
    nothing = F.slice(every, 1, 0)
    all_of = F.concat(every, *[F.when(c, a).otherwise(nothing) for c, a in some])
    return layout_pages(documents).select("doc_id", "page", F.inline(all_of))


def page_text(documents: DataFrame) -> DataFrame:
    p = block_plan(documents)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("doc_id", "page").agg(joined.alias("text")).withColumn(
        "text", F.when((F.col("doc_id") + F.col("page")) % 17 == 0, "").otherwise(F.col("text"))
    )


def recognized_lines(documents: DataFrame) -> DataFrame:
    """Recognised text of inline-math lines; one is missing on every fifth page, some are blank."""
    from pyspark.sql import Window

    from folioframe.sources.layout import unwrap_groups

    lines = (
        unwrap_groups(layout_blocks(documents)).where("block_type = 'TextInlineMath'")
        .select("doc_id", "page", "seq", "part", F.posexplode("raw_lines").alias("j", "line"))
        .where("not line.removed")
    )
    w = Window.partitionBy("doc_id", "page").orderBy("seq", "part", "j")
    text = F.when((F.col("doc_id") + F.col("ord")) % 7 == 0, " ").otherwise(
        F.concat(F.lit("<i>rec</i> "), F.col("line.text"))
    )
    return (
        lines.withColumn("ord", F.row_number().over(w) - 1)
        .where("not (page % 5 = 0 and ord = 0)").select("doc_id", "page", "ord", text.alias("text"))
    )


def bronze(documents: DataFrame) -> dict:
    return {
        "layout_blocks": layout_blocks(documents), "layout_pages": layout_pages(documents),
        "drawings": drawings(documents), "page_text": page_text(documents),
        "recognized_lines": recognized_lines(documents),
    }
