"""Vector code compression: a vector becomes one small code per part, by codebooks that active-entry Lloyd fits.

Vectors are cut into equal parts, and each part position has its own codebook. A round assigns every part
to its nearest entry and then moves every entry to the mean of its parts. A part keeps its entry and the
exact distance to it from round to round. Where that entry stayed fixed, the stored distance is still
right and still the least among the entries that stayed, so only entries that moved are compared with it.
All other parts compare with all entries. All numbers are whole, so both ways give the same choice.

The vectors never meet: a round is one pass over them with the codebooks (parts x entries x width numbers)
in hand, and only sums per part and entry come back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import drop, stage
from folioframe.llm.topk import usable, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Components up to this size keep every sum of squares below inside 64 bits.
MOST = 1 << 24
# A label with more than this share of the rows is joined by a broadcast; there are at most 1 / HOT of them.
HOT = 0.001


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``entries``; floating-point products only where they are exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, entries)
    code = d.argmin(axis=1)  # the first, so the lower index, where several are as near
    return code, d[np.arange(len(x)), code]


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None, dist: np.ndarray | None = None, moved: np.ndarray | None = None):
    """Nearest entry of each row of ``x`` (one part position): codes, squared distances, and how many distances were worked out.

    ``code`` and ``dist`` are those before the entries in ``moved`` moved; without them every row is compared with every entry.
    """
    if code is None:
        return *_nearest(x, entries), x.shape[0] * len(entries)
    code, dist = code.copy(), dist.copy()
    again = moved[code]
    count = 0
    if again.any():
        code[again], dist[again] = _nearest(x[again], entries)
        count += int(again.sum()) * len(entries)
    stayed, active = np.flatnonzero(~again), np.flatnonzero(moved)
    if len(stayed) and len(active):
        at, d = _nearest(x[stayed], entries[active])
        at = active[at]
        better = (d < dist[stayed]) | ((d == dist[stayed]) & (at < code[stayed]))
        code[stayed[better]], dist[stayed[better]] = at[better], d[better]
        count += len(stayed) * len(active)
    return code, dist, count


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows`` with code, dist and compared (how many distances were worked out, in all rounds so far) as the codebooks now give them."""
    parts = len(books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column("v"), parts)
            n = len(v)
            code, dist = np.empty((n, parts), dtype=np.int64), np.empty((n, parts), dtype=np.int64)
            work = np.zeros(n, dtype=np.int64)
            held = None
            if moved is not None:
                held = (np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64),
                        batch.column("dist").flatten().to_numpy(zero_copy_only=False).reshape(n, parts))
                work += batch.column("compared").to_numpy(zero_copy_only=False)
            for p in range(parts):
                before = (held[0][:, p], held[1][:, p], moved[p]) if held else ()
                code[:, p], dist[:, p], _ = assign(v[:, p], books[p], *before)
                work += np.where(moved[p][before[0]], books.shape[1], moved[p].sum()) if held else books.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts), pa.int32()), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), lists, pa.array(work)],
                names=["vec_id", "label", "v", "code", "dist", "compared"])

    kinds = [rows.schema[c] for c in ("vec_id", "label", "v")]
    more = [T.StructField("code", T.BinaryType()), T.StructField("dist", T.ArrayType(T.LongType())), T.StructField("compared", T.LongType())]
    return stage(rows.mapInArrow(run, T.StructType([*kinds, *more])))


def _moved_entries(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry at the floored mean of its parts; an entry without parts stays."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column("v"), parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(v), parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], v[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        p, j = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(j), pa.array(counts[p, j]), *[pa.array(sums[p, j, i]) for i in range(width)]],
                                             names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    names = [f"s{i}" for i in range(width)]
    found = rows.select("v", "code").mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    new = books.copy()
    # At most parts x entries rows.
    for r in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        new[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return new


def _label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: the errors of all rows of the label together. Frequent labels don't meet in one task."""
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("label", "_label"))
    least = max(1, int(HOT * (sums.agg(F.sum("_n")).first()[0] or 0)))
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = F.broadcast(sums.where(F.col("_n") > least))
    near = rows.join(hot, same, "left")
    done = near.where(F.col("_n").isNotNull())
    rest = near.where(F.col("_n").isNull()).drop("label_error", "_label", "_n").join(sums.where(F.col("_n") <= least), same)
    return done.unionByName(rest).drop("_label", "_n")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label; further columns are ignored), one row per vector that takes part.

    A component x becomes floor(scale * x). The codebook of each of ``parts`` equal parts starts as that part of the ``entries``
    (256 at most) vectors with the smallest vec_id; ``rounds`` rounds of Lloyd follow, and a last assignment. Returns vec_id, label,
    code (bytes, one entry index per part), error (squared distances of all parts), label_error (the errors of all rows of
    the label; null labels are one label), compared (distances worked out for the row in all rounds), codebooks_sha256.

    A vector that is null, empty, or holds a null or non-finite component takes no part; nor does one of another length than
    that of the smallest vec_id, or with a component of 2^24 or more after scaling. A null vec_id comes after all others. Repeated
    rows, and different vectors with one vec_id, are rows of their own; among these the smaller vector comes first. With fewer vectors than
    ``entries`` the codebooks are shorter. An empty table gives an empty result. A length that ``parts`` does not divide is a ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") > 0)).select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("v"))
    kept = kept.where(~F.exists("v", lambda x: (x >= MOST) | (x <= -MOST))).withColumn("v", F.col("v").cast("array<int>"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == length)
    start = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]  # at most 256 vectors
    books = np.array(start or [[0] * parts], dtype=np.int64).reshape(max(1, len(start)), parts, -1).transpose(1, 0, 2).copy()
    rows = _assigned(kept, books, None)
    for _ in range(rounds):
        new = _moved_entries(rows, books)
        moved = (new != books).any(axis=2)
        books, old = new, rows
        rows = _assigned(old, books, moved)
        drop(old)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda t, d: t + d)
    return _label_errors(rows.select("vec_id", "label", "code", error.alias("error"), "compared")).withColumn("codebooks_sha256", F.lit(digest))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by complete comparison in every round."""
    text = f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select vec_id, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] x from v, range({parts}) t(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 j, x c from x where vec_id in (select vec_id from v order by vec_id limit {entries}))"""
    for r in range(rounds + 1):
        text += f""",
a{r} as (select vec_id, p, any_value(x) x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * {entries} + j)::bigint k
  from x join b{r} using (p) group by vec_id, p)"""
        if r < rounds:
            text += f""",
m{r} as (select p, k % {entries} j, i, floor(sum(x[i]) / count(*)) m from a{r}, range(1, 1 + (select max(len(x)) from x)) t(i) group by p, j, i),
n{r} as (select p, j, list(m order by i) m from m{r} group by p, j),
b{r + 1} as (select p, j, coalesce(m, c) c from b{r} left join n{r} using (p, j))"""
    return text + f""",
s as (select sha256(string_agg(c[i]::bigint::varchar, ',' order by p, j, i)) h from b{rounds}, range(1, 1 + (select max(len(x)) from x)) t(i)),
e as (select vec_id, string_agg(printf('%02x', k % {entries}), '' order by p) code, sum(k // {entries})::bigint error from a{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from e join v using (vec_id), s"""
