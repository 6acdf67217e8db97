"""Geometry over boxes held as four double columns. Every function returns a native Column."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V

Box = namedtuple("Box", "x0 y0 x1 y1")


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in Box._fields])


def box_of(struct) -> Box:
    s = F.col(struct) if isinstance(struct, str) else struct
    return Box(*[s[c] for c in Box._fields])


def box_struct(b: Box, *others: Box) -> Column:
    """The box as a struct, or the union with further boxes."""
    if not others:
        return F.struct(*[getattr(b, c).alias(c) for c in Box._fields])
    every = (b, *others)
    return F.struct(
        F.least(*[o.x0 for o in every]).alias("x0"), F.least(*[o.y0 for o in every]).alias("y0"),
        F.greatest(*[o.x1 for o in every]).alias("x1"), F.greatest(*[o.y1 for o in every]).alias("y1"),
    )


def union_bbox(boxes) -> Column:
    """The union of an array of box structs."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    low = lambda c: F.array_min(F.transform(b, lambda x: x[c]))
    high = lambda c: F.array_max(F.transform(b, lambda x: x[c]))
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def upper_median(values) -> Column:
    """``sorted(v)[n // 2]`` of the positive values, 0.0 when there is none."""
    pos = F.array_sort(F.filter(values, lambda v: v > 0))
    at = F.floor(F.size(pos) / 2).cast("int") + 1
    return F.coalesce(F.try_element_at(pos, at), F.lit(0.0))


def line_height(boxes) -> Column:
    return upper_median(F.transform(boxes, lambda b: b["y1"] - b["y0"]))


def _safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(0.0)


def x_overlap_ratio(a: Box, b: Box) -> Column:
    inter = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    return F.when(inter > 0, _safe_ratio(inter, F.least(a.x1 - a.x0, b.x1 - b.x0))).otherwise(0.0)


def x_overlaps(a: Box, b: Box) -> Column:
    return x_overlap_ratio(a, b) >= 0.3


def h_overlap(a: Box, b: Box) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    return inter / F.greatest(F.lit(1e-6), F.least(a.x1 - a.x0, b.x1 - b.x0))


def v_overlap(a: Box, b: Box) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return inter / F.greatest(F.lit(1e-6), F.least(a.y1 - a.y0, b.y1 - b.y0))


def intersection_area(a: Box, b: Box) -> Column:
    ix = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    iy = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return ix * iy


def area(a: Box) -> Column:
    return (a.x1 - a.x0) * (a.y1 - a.y0)


def area_overlap(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return F.when(inter <= 0, 0.0).otherwise(inter / F.greatest(F.lit(1e-6), F.least(area(a), area(b))))


def same_object(a: Box, b: Box) -> Column:
    return area_overlap(a, b) >= V.SAME_OBJECT


def inside_region(a: Box, region: Box) -> Column:
    return intersection_area(a, region) >= V.CALLOUT_INSIDE * F.greatest(F.lit(1e-6), area(a))


def width_kind(b: Box, lo: Column, hi: Column) -> Column:
    w = hi - lo
    share = _safe_ratio(b.x1 - b.x0, w)
    return (
        F.when(w <= 0, "mid").when(share >= V.WIDE_FRACTION, "wide").when(share <= V.NARROW_FRACTION, "narrow")
        .otherwise("mid")
    )


def column_kind(b: Box, lo: Column, hi: Column) -> Column:
    w, mid = hi - lo, lo + (hi - lo) / 2
    return (
        F.when((w <= 0) | (b.x1 - b.x0 >= 0.75 * w), "full").when(b.x1 <= mid + 0.12 * w, "left")
        .when(b.x0 >= mid - 0.12 * w, "right").otherwise("other")
    )


def spans_page(b: Box, lo: Column, hi: Column) -> Column:
    """A block that reaches both content edges or crosses the gutter between two columns."""
    w, mid = hi - lo, lo + (hi - lo) / 2
    edges = (b.x0 <= lo + 0.12 * w) & (b.x1 >= hi - 0.12 * w)
    crosses = (b.x0 < mid - 0.05 * w) & (b.x1 > mid + 0.05 * w)
    return (w <= 0) | edges | crosses


def layout_type(b: Box, lo: Column, hi: Column) -> Column:
    left_of_mid = (b.x0 + b.x1) / 2 < lo + (hi - lo) / 2
    return (
        F.when(spans_page(b, lo, hi), "one-column").when(left_of_mid, "left-column").otherwise("right-column")
    )


def layout_predecessor_ok(prev_type, cur_type) -> Column:
    c = F.col(cur_type) if isinstance(cur_type, str) else cur_type
    p = F.col(prev_type) if isinstance(prev_type, str) else prev_type
    right_may_follow = F.coalesce(p.isin("left-column", "right-column"), F.lit(False))
    return F.when(c == "right-column", right_may_follow).otherwise(True)


def math_adjacent(a: Box, b: Box) -> Column:
    h = F.greatest(F.lit(1.0), F.least(a.y1 - a.y0, b.y1 - b.y0))
    return (h_overlap(a, b) >= V.MATH_OVERLAP) & (b.y0 - a.y1 <= h * V.MATH_GAP_FACTOR)


def panels_contiguous(u: Box, n: Box) -> Column:
    h, gap = F.least(u.y1 - u.y0, n.y1 - n.y0), n.y0 - u.y1
    return (
        (h_overlap(u, n) >= V.PANEL_H_OVERLAP) & (gap >= -V.PANEL_SLOP * h) & (n.y1 > u.y1 + V.GEOM_TOL)
        & (gap <= F.greatest(F.lit(V.PANEL_GAP), V.PANEL_GAP_FRACTION * h))
    )


def panels_side_by_side(u: Box, n: Box) -> Column:
    w, gap = F.least(u.x1 - u.x0, n.x1 - n.x0), n.x0 - u.x1
    return (
        (v_overlap(u, n) >= V.PANEL_V_OVERLAP) & (gap >= -V.GEOM_TOL)
        & (gap <= F.greatest(F.lit(V.PANEL_GAP), V.PANEL_GAP_FRACTION * w))
    )


def is_decorative_icon(b: Box, caption_text) -> Column:
    w, h = F.greatest(F.lit(0.0), b.x1 - b.x0), F.greatest(F.lit(0.0), b.y1 - b.y0)
    bare = F.coalesce(F.col(caption_text) if isinstance(caption_text, str) else caption_text, F.lit("")) == ""
    return bare & (((w < V.ICON_W) & (h < V.ICON_H)) | (w * h < V.ICON_AREA))


def is_whiteish(fill) -> Column:
    f = F.col(fill) if isinstance(fill, str) else fill
    bare = f.isNull() | (F.size(f) == 0)
    return bare | F.forall(F.slice(F.coalesce(f, F.array().cast("array<double>")), 1, 3), lambda c: c >= V.WHITEISH)


def same_column(a: Box, b: Box) -> Column:
    narrower = F.least(a.x1 - a.x0, b.x1 - b.x0)
    return _safe_ratio(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), narrower) >= 0.5


def gap_cover(prev: Box, nxt: Box, other: Box) -> Column:
    """Height of the gap between two blocks that a third block in their column fills."""
    near = x_overlaps(prev, other) | x_overlaps(nxt, other)
    return F.when(
        near, F.greatest(F.lit(0.0), F.least(nxt.y0, other.y1) - F.greatest(prev.y1, other.y0))
    ).otherwise(0.0)


def continuation_geometry_ok(prev: Box, prev_page, nxt: Box, next_page, line_h, covered, prev_lo, prev_hi,
                             next_lo, next_hi) -> Column:
    """True when two paragraphs can be one flow of text: downward, column wrap, or page wrap.

    ``covered`` is the height of their gap that other blocks fill.
    """
    kinds = F.concat_ws("|", width_kind(prev, prev_lo, prev_hi), width_kind(nxt, next_lo, next_hi))
    clash = kinds.isin("wide|narrow", "narrow|wide")
    over_page = column_kind(prev, prev_lo, prev_hi).isin("right", "full") & column_kind(nxt, next_lo, next_hi).isin(
        "left", "full"
    )
    down = (nxt.y0 >= prev.y0 - V.GEOM_TOL) & (
        (line_h <= 0) | (nxt.y0 - prev.y1 - covered <= V.MAX_GAP_LINES * line_h)
    )
    narrower = F.least(prev.x1 - prev.x0, nxt.x1 - nxt.x0)
    wrap = (nxt.x0 >= prev.x0 + 0.5 * narrower) & (nxt.y0 <= prev.y0 + V.GEOM_TOL)
    return (
        F.when(clash, False).when(next_page < prev_page, False).when(next_page > prev_page, over_page)
        .when(same_column(prev, nxt), down).otherwise(wrap)
    )
