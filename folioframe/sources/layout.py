"""Reading layout tables: groups unwrapped, lines cleaned, one row per block.

Rows carry ``span``, the number of a run of ``SPAN_PAGES`` pages. All page work is partitioned by
``(doc_id, span)``, so one huge document spreads over many tasks, and what has to cross spans travels
as one small summary row per span (see ``operators.scans``).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T

SPAN_PAGES = 64
PAGE_KEY = ["doc_id", "span", "page"]


def span_of(page):
    return F.floor((F.col(page) - 1) / SPAN_PAGES).cast("int")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def unwrap_groups(raw: DataFrame) -> DataFrame:
    """Skip removed blocks and put the children of a figure, picture or table group in its place. Rows that have their span keep it, and so lie where it put them."""
    own = F.array(F.struct("block_type", "removed", "bbox", "html", "lines"))
    is_group = F.col("block_type").isin(V.GROUP_TYPES) & (F.coalesce(F.size("children"), F.lit(0)) > 0)
    kids = F.when(is_group, F.filter("children", lambda c: ~F.coalesce(c["removed"], F.lit(False)))).otherwise(own)
    return (
        raw.where(~F.coalesce("removed", F.lit(False)))
        .select("doc_id", *[c for c in raw.columns if c == "span"], "page", "seq", F.posexplode(kids).alias("part", "b"))
        .select(
            "doc_id", "page", F.col("span") if "span" in raw.columns else span_of("page").alias("span"), "seq", "part",
            F.col("b.block_type").alias("block_type"), F.col("b.html").alias("html"),
            *[F.round(F.col(f"b.bbox.{c}"), 2).alias(c) for c in G.Box._fields],
            F.col("b.lines").alias("raw_lines"),
        )
    )


def line_text(line) -> F.Column:
    """Text of a line; recognised math in a span wins over the glyphs under it."""
    def piece(s):
        html = T.strip_math_tags(s["html"])
        return F.when(F.coalesce(s["math"], F.lit(False)) & (F.length(s["html"]) > 0), html).otherwise(
            F.coalesce(s["text"], F.lit(""))
        )

    whole = F.array_join(F.transform(line["spans"], piece), "")
    return F.when(F.coalesce(F.size(line["spans"]), F.lit(0)) > 0, whole).otherwise(line["text"])


def clean_lines(raw_lines, texts=None) -> F.Column:
    """Visual lines of a block: removed ones and empty ones out, spaces collapsed."""
    lines = F.coalesce(F.col(raw_lines), F.expr("array()").cast(f"array<{schemas.LINE}>"))

    def clean(line, i):
        text = line_text(line)
        if texts is not None:
            text = F.coalesce(F.get(texts, i), text)
        return F.struct(
            F.when(~F.coalesce(line["removed"], F.lit(False)), T.normalize_text(text)).alias("text"),
            *[F.round(line["bbox"][c], 2).alias(c) for c in G.Box._fields],
        )

    return F.filter(F.transform(lines, clean), lambda x: x["text"] != "")


def superscript_symbols(raw_lines) -> F.Column:
    """Footnote symbols set as superscript in a block: whole runs and their single characters."""
    spans = F.flatten(F.transform(raw_lines, lambda x: x["spans"]))
    runs = F.filter(
        F.transform(
            F.filter(spans, lambda s: F.coalesce(s["superscript"], F.lit(False))),
            lambda s: T.footnote_symbols_of(F.coalesce(s["text"], F.lit(""))),
        ),
        lambda r: r != "",
    )
    chars = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
    return F.array_distinct(F.concat(runs, F.filter(chars, lambda c: c != "")))


def collect_lines(blocks: DataFrame) -> DataFrame:
    """Add ``lines`` (cleaned), ``text`` (joined) and ``sup`` to unwrapped blocks."""
    texts = F.col("line_texts") if "line_texts" in blocks.columns else None
    return (
        blocks.withColumn("lines", clean_lines("raw_lines", texts))
        .withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), " "))
        .withColumn("sup", F.coalesce(superscript_symbols(F.col("raw_lines")), F.array().cast("array<string>")))
        .drop("raw_lines", "line_texts")
    )


def flat_lines(blocks: DataFrame) -> DataFrame:
    """One row per visual line."""
    return blocks.select(
        "doc_id", "page", "seq", "part", F.posexplode("lines").alias("ln", "line")
    ).select("doc_id", "page", "seq", "part", "ln", "line.*")


def inline_math_override(blocks: DataFrame, recognized: DataFrame) -> DataFrame:
    """Recognised text replaces the lines of inline-math blocks, on pages where the counts agree.

    Recognised lines are numbered through the page in model order. Both sides meet once per page, so
    lines are not exploded: each block takes its stretch of the page's recognised texts.
    """
    from pyspark.sql import Window

    live = F.filter("raw_lines", lambda x: ~F.coalesce(x["removed"], F.lit(False)))
    n = F.when(F.col("block_type") == "TextInlineMath", F.size(live)).otherwise(0)
    per_page = recognized.groupBy("doc_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("rec")
    )
    before = Window.partitionBy(*PAGE_KEY).orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*PAGE_KEY)
    agreed = (F.col("n_math") > 0) & (F.size("rec") == F.col("page_math"))

    def text_at(line, i):
        at = F.col("first") + i - F.size(
            F.filter(F.slice("raw_lines", 1, i), lambda x: F.coalesce(x["removed"], F.lit(False)))
        )
        said = T.strip(F.get("rec", at.cast("int")))
        return F.when(
            agreed & ~F.coalesce(line["removed"], F.lit(False)) & (said != ""), T.strip_math_tags(said)
        )

    return (
        blocks.withColumn("n_math", n)
        .withColumn("first", F.coalesce(F.sum("n_math").over(before), F.lit(0)))
        .withColumn("page_math", F.sum("n_math").over(whole))
        .join(per_page, ["doc_id", "page"], "left")
        .withColumn("line_texts", F.transform("raw_lines", text_at))
        .drop("n_math", "first", "page_math", "rec")
    )


def read_layout(raw: DataFrame, recognized: DataFrame | None = None) -> DataFrame:
    """From the layout table to blocks ready for the document rules."""
    blocks = unwrap_groups(raw)
    if recognized is not None:
        blocks = inline_math_override(blocks, recognized)
    return collect_lines(blocks)
