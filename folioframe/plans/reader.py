"""The reader's view of a corpus: edits applied, text injected, chains and sequences derived."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import edits as E
from folioframe.operators import explain as X
from folioframe.operators import views as W
from folioframe.operators.continuation import chain_ids
from folioframe.session import settle


def reader_view(extraction, override_log: DataFrame) -> dict:
    """Tables of the view. ``override_log``: doc_id, key, edit_id, edited_at and the override fields."""
    fields = ["n", "page", "x0", "y0", "x1", "y1", "role", "continuation", "allow_merges"]
    overrides = E.latest_edit(override_log, ["doc_id", "key"], fields)
    page_rows = E.apply_overrides_pages(extraction.page_rows, overrides)
    linear = E.apply_overrides_linear(extraction.linear, overrides, extraction.page_rows).where("role <> 'ignored'")
    metadata = E.apply_overrides_metadata(extraction.metadata, overrides)
    linear = settle(linear.withColumn("injected", F.lit(False)))
    pages = settle(E.inject_linear_only(page_rows, linear, metadata, extraction.pages))
    chained = settle(chain_ids(linear))
    payloads = X.merged_sentences(X.chain_payload(chained))
    return {
        "page_rows": pages, "linear": chained, "payloads": payloads, "list": W.chain_members(chained, payloads),
        "page_sequence": W.reading_sequence_pages(pages), "linear_sequence": W.reading_sequence_linear(chained),
        "outline": W.section_outline(chained), "display": W.sequence_floats(chained),
    }
