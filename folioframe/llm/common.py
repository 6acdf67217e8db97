"""What the operators of this package share: stage tables, ranks, hashing and batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Arrow batches are bounded by rows and by bytes, so that very long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's code to the executors once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Code and settings for a session that runs these operators; set by the queries and the pipeline, not by the operators."""
    ship(spark)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share: ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it from there: cuts the lineage, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a stage table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, keys: list[str], order: list, name: str, buckets: int = 256, at: Column | None = None) -> DataFrame:
    """Add ``name``: the gapless rank from 0 of each row inside ``keys``, without a key ever meeting in one task.

    Rows go to ``buckets`` parts of each key (by a hash of ``order``, or by ``at``, a number below
    ``buckets``). A window ranks inside a part; the parts' counts, at most keys x buckets small rows,
    give each part its offset. ``order`` must tell all rows apart and must not change when it is
    read again. The ranks are deterministic; they ascend by part, then by ``order``.
    """
    part = at if at is not None else F.pmod(F.xxhash64(*order), F.lit(buckets))
    df = df.withColumn("_part", part.cast("int"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    place = df.withColumn("_row", F.row_number().over(inside))
    joined = place.join(offsets, on=same, how="inner")
    return joined.withColumn(name, F.col("_row") - 1 + F.col("_before")).drop("_part", "_row", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])


def arrow_rows(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that turns a batch into columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of an unsigned array over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_ODD = None


def _powers(n: int) -> np.ndarray:
    """Powers of an odd constant, kept up to a bounded length."""
    global _ODD
    if _ODD is None or len(_ODD) < n:
        size = max(1 << 16, n)
        made = np.cumprod(np.full(size, 0x9E3779B97F4A7C15, dtype=np.uint64))
        if n > 1 << 22:
            return made
        _ODD = made
    return _ODD


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of letters and digits, in lower case, in text order."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    points = code_points(text.lower())
    mask = _word_mask()[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    offset = np.cumsum(sizes) - sizes
    kept = points[mask].astype(np.uint64)
    place = np.arange(len(kept)) - np.repeat(offset, sizes)
    return mix(np.add.reduceat(mix(kept + np.uint64(1)) * _powers(int(sizes.max()))[place], offset) + sizes.astype(np.uint64))


_WORD = None


def _word_mask() -> np.ndarray:
    global _WORD
    if _WORD is None:
        _WORD = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _WORD
