"""Packing into optimal length buckets.

Documents longer than the context are cut into pieces, so no token is lost. The histogram of piece
lengths (one row per length, at most ``context`` rows) is counted over the whole corpus; dynamic
programming over it finds the bucket boundaries with the least padding. Inside each bucket, batches
hold as many pieces as the token budget allows when each is padded to the boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import ranked, stage


def words(text: Column) -> Column:
    """The default length: runs of characters other than white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges that minimise the padding of ``counts`` (length -> pieces).

    The last boundary is the greatest length. Among equally good choices the earlier boundaries are the smaller ones.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    number = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    pieces = np.concatenate(([0], np.cumsum(number))).astype(np.float64)
    tokens = np.concatenate(([0], np.cumsum(number * lengths))).astype(np.float64)
    n, k = len(lengths), min(buckets, len(lengths))
    best, chosen = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(k):
        found, at = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            at[j] = np.argmin(cost)
            found[j] = cost[at[j]]
        chosen.append(at)
        best = found
    out, j = [], n
    for at in reversed(chosen):
        out.append(int(lengths[j - 1]))
        j = int(at[j])
    return out[::-1]


def pack(docs: DataFrame, context: int = 2048, buckets: int = 16, budget: int = 32768, length=words) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text; further columns are ignored) into batches.

    Returns one row per piece: doc_id, piece (from 0), start (its first token in the document),
    n_tokens, bucket (from 0), padded (tokens after padding), batch (gapless in its bucket), slot
    (gapless in its batch). ``length`` gives the tokens of a text. A null or empty text, or one
    without tokens, gives one row with n_tokens 0 and nulls from ``bucket`` on. Repeated rows and
    repeated or null ids are packed like any other row. An empty table gives an empty result.
    """
    sized = stage(docs.select("doc_id", length(F.col("text")).alias("total"), F.monotonically_increasing_id().alias("rid")))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / context) - 1).cast("long")
    pieces = sized.select("doc_id", "total", "rid", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "rid", "piece", (F.col("piece") * context).alias("start"),
        F.least(F.lit(context).cast("long"), F.col("total") - F.col("piece") * context).alias("n_tokens"))
    # At most ``context`` rows: the lengths of pieces.
    counts = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = boundaries(counts, buckets)
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", F.lit(None).cast("int").alias("bucket"), *[
        F.lit(None).cast("long").alias(c) for c in ("padded", "batch", "slot")])
    if not ends:
        return none
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    full = pieces.where("n_tokens > 0").withColumn("bucket", bucket.cast("int")).withColumn(
        "padded", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    parts = int(min(4096, max(64, sum(counts.values()) // (100_000 * len(ends)))))
    full = ranked(full, ["bucket"], ["rid", "piece"], "place", parts)
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded")))
    return full.select("doc_id", "piece", "start", "n_tokens", "bucket", "padded", F.floor(F.col("place") / size).alias("batch"),
                       (F.col("place") % size).alias("slot")).unionByName(none)
