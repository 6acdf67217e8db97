"""Values that flow through a whole document, without putting a document into one task.

A document is cut into spans of pages. Inside a span a window does the work; between spans only one
summary row per span travels, through a window over the document, and is joined back on
``(doc_id, span)``. A document that holds a third of all rows therefore still spreads over many tasks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import SPAN, tasks

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def by_span(df: DataFrame) -> DataFrame:
    """Deal rows out by ``(doc_id, span)``, ahead of page windows: these, the scans and the joins by row that follow need no other exchange."""
    return df.repartition(tasks(df.sparkSession), *SPAN)


def doc_scan(df: DataFrame, order: list, inclusive: bool = False, **specs) -> DataFrame:
    """Add running values and totals of a document; ``order`` must ascend with the page.

    ``specs``: name -> (kind, column). Running kinds are "sum", "max" and "last" (last non-null value);
    they count the current row only when ``inclusive``. "next" is the first non-null value further down. "total_min", "total_max" and "total_sum" cover
    the whole document.
    """
    held = df.select("*", *[col.alias(f"_v_{n}") for n, (_, col) in specs.items()])
    inside = Window.partitionBy(*SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*SPAN).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    after = doc.orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*order)
    per_span, carried, local, final = [], [], [], []
    for n, (kind, _) in specs.items():
        v, c, here = F.col(f"_v_{n}"), f"_c_{n}", f"_l_{n}"
        if kind.startswith("total_"):
            fn = _AGG[kind.removeprefix("total_")]
            per_span.append(fn(v).alias(c))
            carried.append(fn(c).over(doc).alias(c))
            final.append(F.col(c).alias(n))
        elif kind == "next":
            per_span.append(F.min_by(v, F.when(v.isNotNull(), place)).alias(c))
            carried.append(F.first(c, True).over(after).alias(c))
            local.append(F.first(v, True).over(below).alias(here))
            final.append(F.coalesce(here, c).alias(n))
        elif kind == "last":
            per_span.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(c))
            carried.append(F.last(c, True).over(before).alias(c))
            local.append(F.last(v, True).over(inside).alias(here))
            final.append(F.coalesce(here, c).alias(n))
        else:
            per_span.append(_AGG[kind](v).alias(c))
            carried.append(_AGG[kind](c).over(before).alias(c))
            local.append(_AGG[kind](v).over(inside).alias(here))
            zero = F.lit(0)
            final.append(
                (F.coalesce(F.col(here), zero) + F.coalesce(F.col(c), zero) if kind == "sum"
                 else F.greatest(here, c)).alias(n)
            )
    # Dealt out as the rows are: else the join might move the rows to where the summaries lie.
    summary = by_span(held.groupBy(*SPAN).agg(*per_span).select(*SPAN, *carried))
    kept = [c for c in df.columns if c not in specs]
    return held.select("*", *local).join(summary, SPAN, "left").select(*kept, *final)


def dense_index(df: DataFrame, order: list, name: str = "idx", counts=None) -> DataFrame:
    """Number the rows of a document 0, 1, 2 … in ``order``; with ``counts``, only rows where it holds."""
    one = F.lit(1) if counts is None else F.when(counts, 1)
    return doc_scan(df, order, **{name: ("sum", one)}).withColumn(name, F.col(name).cast("int"))
