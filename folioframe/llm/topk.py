"""Exact top-k search by global score histograms.

Every query is scored against every row, in blocks: rows and queries are packed into blocks of bounded
size, and each pair of blocks is one matrix product of whole numbers. Scores are not kept. A pass
counts them per query in bins; the counts of all blocks together say in which bin the k-th best score
lies, and the next pass counts inside that bin only, until the bin holds one score. A last pass emits
what reaches that score and breaks ties by the smaller id.

A block sends only the bins from the top down to its own k-th best score: the global k-th best score
is never below that of a part. So a block sends at most k counts per query, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import drop, stage

BINS = 4096


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _blocks(df: DataFrame, block: Column, name: str, *extra: str) -> DataFrame:
    """Rows (id, v, ...) packed into one row per block."""
    return df.withColumn(name, block).groupBy(name).agg(F.collect_list(F.struct("id", "v", *extra)).alias("rows"))


def _matrix(rows: pa.StructArray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.float64 if exact else np.int64)


def _scores(batches: Iterator[pa.RecordBatch], exact: bool):
    """For each pair of blocks: the queries' rows, their ids, the candidates' ids, and the scores; a query's own row has no score."""
    for batch in batches:
        queries, rows = batch.column(batch.schema.get_field_index("queries")), batch.column(batch.schema.get_field_index("rows"))
        for i in range(batch.num_rows):
            q, c = queries.slice(i, 1).flatten(), rows.slice(i, 1).flatten()
            q_ids, left = _matrix(q, exact)
            c_ids, right = _matrix(c, exact)
            score = (left @ right.T).astype(np.int64)
            yield q, q_ids, c_ids, score, q_ids[:, None] != c_ids[None, :]


def _count(exact: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, q_ids, _, score, other in _scores(batches, exact):
            low, width = (q.field(n).to_numpy(zero_copy_only=False)[:, None] for n in ("low", "width"))
            # Scores above the range of a query fall into bin BINS: they count, but need no place.
            bins = np.where(other & (score >= low), np.minimum((score - low) // width, BINS), -1)
            n = len(q_ids)
            counts = np.bincount((bins + 1 + np.arange(n)[:, None] * (BINS + 2)).ravel(), minlength=n * (BINS + 2)).reshape(n, BINS + 2)[:, :0:-1]
            sent = (counts > 0) & (np.cumsum(counts, axis=1) - counts < k)
            at, down = np.nonzero(sent)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(BINS - down), pa.array(counts[at, down])], names=["id", "bin", "n"])
    return run


def _emit(exact: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, q_ids, c_ids, score, other in _scores(batches, exact):
            at, to = np.nonzero(other & (score >= q.field("low").to_numpy(zero_copy_only=False)[:, None]))
            found = score[at, to]
            order = np.lexsort((c_ids[to], -found, at))
            at, to, found = at[order], to[order], found[order]
            # Of ties in one block only the first k by id can be among the k best.
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at][first]), pa.array(c_ids[to][first]), pa.array(found[first])], names=["id", "other", "score"])
    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, query_block: int = 512, row_block: int = 4096, spread: int = 64) -> DataFrame:
    """The ``k`` greatest inner products of each query with all other rows: id, rank (from 1), other, score.

    Both tables have id (long) and v (array of long). A row with a query's id is not among its candidates; ties
    go to the smaller id. Equal rows of ``queries`` count once; equal rows of ``rows`` are candidates each. Shorter vectors
    are filled up with zeros. Null ids, vectors and components must have been taken out. Fewer than
    ``k`` candidates give all; an empty table gives an empty result. Scores are exact while a sum of products stays below 2**63.
    """
    shape = rows.unionByName(queries).agg(
        F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)).alias("norm")).first()
    n_rows, n_queries = rows.count(), queries.count()
    if not n_rows or not n_queries:
        return rows.limit(0).selectExpr("id", "1 as rank", "id as other", "0L as score")
    dim, most = max(1, shape["dim"]), shape["most"] or 0
    exact = most * most * dim < 1 << 53  # then doubles hold every sum, and the product is a fast one
    fill = lambda df: df.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    q_blocks, c_blocks = -(-n_queries // query_block), -(-n_rows // row_block)
    # Block numbers come from hashes, so no row is ever numbered in one task.
    packed = stage(_blocks(fill(rows).withColumn("at", F.monotonically_increasing_id()), F.pmod(F.xxhash64("at"), F.lit(c_blocks)), "c"))
    bound = int(shape["norm"] or 0) + 1  # no score is beyond the greatest squared length
    step = -(-(2 * bound + 1) // BINS)
    asked = stage(fill(queries.distinct()).withColumn("low", F.lit(-bound).cast("long")).withColumn("width", F.lit(step).cast("long")))
    salts = min(spread, c_blocks)

    def pairs(state: DataFrame) -> DataFrame:
        block = _blocks(state, F.pmod(F.xxhash64("id"), F.lit(q_blocks)), "q", "low", "width")
        left = block.select("q", F.col("rows").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        right = packed.select("rows", F.pmod("c", F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q"))
        return right.join(left, ["q", "salt"]).select("queries", "rows")

    down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        counts = pairs(asked).mapInArrow(_count(exact, k), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # The bin of the k-th best score, or the lowest one if there are fewer.
        place = counts.withColumn("upto", F.sum("n").over(down)).groupBy("id").agg(
            F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
        low = F.col("low") + F.col("bin") * F.col("width")
        newer = stage(asked.join(place, "id").select("id", "v", low.alias("low"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("width") / BINS)).alias("width")))
        drop(asked)
        asked = newer
        if step == 1:
            break
        step = -(-step // BINS)
    found = pairs(asked).mapInArrow(_emit(exact, k), "id long, other long, score long")
    ranks = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("id", "rank", "other", "score")
