"""Small tables of linear and page rows for tests."""

from pyspark.sql import functions as F

from folioframe.operators import walk as W

BASE = "doc_id long, page int, ri int, kind string, role string, text string, x0 double, y0 double, x1 double, y1 double, caption_text string"


def row(role, text, x0, y0, x1, y1, ri, page=1, doc=1, caption=""):
    kind = "image" if role in ("figure", "table", "algorithm") else "block"
    return (doc, page, ri, kind, role, text, float(x0), float(y0), float(x1), float(y1), caption)


def table(spark, rows, pages=False):
    df = spark.createDataFrame(rows, BASE).select(
        "doc_id", F.floor((F.col("page") - 1) / 64).cast("int").alias("span"), "page", "ri", "kind", "role", "text", "x0", "y0", "x1", "y1",
        W.empty(W.NO_SENTENCES).alias("sentences"), W.empty(W.NO_NOTES).alias("footnotes"), F.lit(False).alias("continuation"),
        "caption_text", F.lit(None).cast(W.NO_BOX).alias("caption_bbox"))
    return df if pages else df.drop("kind")
