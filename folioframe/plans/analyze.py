"""The whole analysis of a corpus: extraction, document map, nested result."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import continuation as C
from folioframe.operators import explain as E
from folioframe.plans.extract import extract_both
from folioframe.session import settle
from folioframe.sources.catalog import nest_analysis


def analyze(bronze: dict, info: DataFrame, client_factory: Callable, wait: bool = True) -> DataFrame:
    """Nested analyses of all documents. ``info``: doc_id, filename, language.

    A document whose map cannot be had is not part of the result, as a failed job leaves none.
    """
    x = extract_both(bronze)
    texts = C.full_text(x.page_rows.where("kind = 'block'"))
    prompt = F.concat("full_text", E.language_rule(F.col("language")))
    asked = texts.join(info.select("doc_id", "language"), "doc_id").select("doc_id", prompt.alias("prompt"))
    asked = settle(E.score_requests(asked, client_factory, wait=wait))
    maps = E.parse_model_json(asked, schemas.GLOBAL_MAP).where("parsed is not null").select("doc_id", F.col("parsed").alias("global_map"))
    return nest_analysis(x.pages, x.page_rows, x.linear, x.metadata, info.join(maps, "doc_id"))
