"""From layout tables to clean documents: the two projections, metadata, and the whole analysis."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import continuation as C
from folioframe.operators import merges as M
from folioframe.operators import metadata as D
from folioframe.operators import scans
from folioframe.operators import walk as W
from folioframe.session import settle, tune
from folioframe.sources.layout import read_layout


@dataclass
class Extraction:
    """The tables of a corpus: emitted pages, page rows (blocks and images), linear rows, metadata."""

    pages: DataFrame
    page_rows: DataFrame
    linear: DataFrame
    metadata: DataFrame


def walked(bronze: dict) -> DataFrame:
    tune(bronze["layout_blocks"].sparkSession)
    blocks = read_layout(bronze["layout_blocks"], bronze.get("recognized_lines"))
    return W.walk(blocks, bronze.get("drawings"), bronze["layout_pages"])


def extract_pages(bronze: dict) -> DataFrame:
    """Blocks and images per page, before merges."""
    return W.page_rows(walked(bronze))


def extract_linear(bronze: dict) -> DataFrame:
    """Blocks in reading order of the document, before merges."""
    return W.linear_rows(walked(bronze))


# What neither continuation nor layout reads.
CARRIED = ["sentences", "footnotes", "caption_text", "caption_bbox"]


def finish_pages(rows: DataFrame, icons: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """``icons`` = False keeps small pictures, as the single-projection helper does. ``texts``: the rows without sentences and notes, where cheaper."""
    rows = M.merge_algorithms(M.merge_captions_and_notes_pages(rows, texts), pages=True)
    if icons:
        rows = M.drop_decorative_icons(rows)
    rows = settle(rows)
    marks = settle(C.bridge_display_math(C.continuation_pages(scans.by_span(rows.drop(*CARRIED))), "kind").select(*M.ROW_KEY, "continuation"))
    return rows.drop("continuation").join(marks, M.ROW_KEY).select(*rows.columns)


def finish_linear(rows: DataFrame, tables_again: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """``tables_again`` = False runs the table merge once, as the single-projection helper does. ``texts`` as for ``finish_pages``."""
    rows = scans.by_span(settle(M.merge_tables_linear(rows.drop("ord"), texts)))
    rows = M.merge_algorithms(M.merge_figure_captions_linear(rows), pages=False)
    if tables_again:
        rows = M.merge_tables_linear(settle(rows))
    rows = settle(M.drop_decorative_icons(rows))
    # From here on only marks change; whole rows, which keep their number in ``own``, take them at the end.
    own = rows.withColumn("own", F.col("ri"))
    key = [*M.ROW_KEY[:-1], "own"]
    lh = F.when(F.col("role") == "paragraph", C.sentence_line_height()).otherwise(0.0)
    moved = settle(C.with_layout_type(C.authors_after_title(own.withColumn("lh", lh).drop(*CARRIED))).drop("text"))
    flow = C.continuation_linear(scans.by_span(moved.join(own.select(*key, "text"), key)))
    changed = ["ri", "role", "y1", "continuation"]
    marks = settle(C.clip_overlaps(C.bridge_display_math(flow)).select(*key, *changed, "layout_type"))
    return own.drop(*changed).join(marks, key).select(*rows.columns, "layout_type")


def _projections(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = scans.by_span(w)
    return finish_pages(W.page_rows(w), texts=W.page_rows(w, bare=True)), finish_linear(W.linear_rows(w), texts=W.linear_rows(w, bare=True))


def extract_both(bronze: dict) -> Extraction:
    w = walked(bronze)
    page_rows, linear = _projections(w)
    pages = W.emitted_pages(w, bronze["layout_pages"])
    metadata = D.metadata_blocks(w, page_rows, linear, pages)
    return Extraction(pages, page_rows, D.flat_block_refs(linear, page_rows), metadata)


def document_texts(bronze: dict) -> DataFrame:
    """Clean text of each document, from the page projection."""
    return C.full_text(finish_pages(extract_pages(bronze)).where(F.col("kind") == "block"))
