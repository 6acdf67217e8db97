"""A bucketed store of rows by key, with copy-on-write and a manifest.

Rows lie in a fixed number of buckets by a hash of their key, which is Spark's own: rows that lie by key over ``write_tasks`` tasks are written where they are, a task to a bucket. A write puts new files for the buckets it touches below
``data/version=<name>`` and then names, in one small new file below ``manifest``, the versions that make up each bucket; readers
follow the last manifest only, so a write that broke off changes nothing. The number of folders grows with writes and buckets,
not with keys, and a read of some buckets opens only their files. A store has one writer at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.session import settle, tasks

BUCKETS, MOST_VERSIONS = 64, 8
_MANIFEST = "seq long, bucket int, versions array<string>, buckets int, hash string"


def write_tasks(spark: SparkSession, buckets: int = BUCKETS) -> int:
    """Over how many tasks rows are dealt out by key ahead of a write: a multiple of the buckets, so that a task has rows of one bucket only."""
    return buckets * -(-tasks(spark) // buckets)


class BucketStore:
    """Rows of ``schema`` (DDL) at ``path``; ``buckets`` counts when the store is made, later the store knows it.

    A bucket that ``append`` has given more than ``MOST_VERSIONS`` versions is written anew as one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "doc_id", fmt: str = "parquet", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.fmt = spark, path.rstrip("/"), key, fmt
        self.schema = T.StructType.fromDDL(schema)
        self.hash = "murmur3"
        held = self.manifest()
        self.buckets = next(iter(held.values()))[1] if held else buckets

    def manifest(self) -> dict[int, tuple[list[str], int]]:
        """The versions of each bucket (at most one row per bucket reaches the driver); empty for a new store."""
        try:
            every = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest")  # in folders seq=1, seq=2, ...
            last = every.agg(F.max("seq")).first()[0]
            rows = every.where(F.col("seq") == last).collect() if last is not None else []
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.seq = rows[0]["seq"] if rows else 0
        if rows:
            # Older stores name no hash.
            self.hash = rows[0]["hash"] or "xxhash64"
        return {r["bucket"]: (r["versions"], r["buckets"]) for r in rows}

    def _bucket(self) -> F.Column:
        return F.pmod((F.hash if self.hash == "murmur3" else F.xxhash64)(self.key), F.lit(self.buckets)).cast("int")

    def _files(self, held: dict, wanted=None) -> list[str]:
        return [f"{self.path}/data/version={v}/bucket={b}" for b, (versions, _) in sorted(held.items()) if wanted is None or b in wanted for v in versions]

    def _load(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.fmt).load(files)

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows as of now; with ``buckets``, only files of these."""
        return self._load(self._files(self.manifest(), buckets))

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets in which the keys of ``rows`` lie."""
        return {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is among ``keys``, from the files of their buckets alone."""
        return self.read(self.touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(write_tasks(self.spark, self.buckets), self.key)

    def _write(self, rows: DataFrame, version: str) -> set[int]:
        """Write ``rows``, which are computed once, and say which buckets have some. Rows that lie by key already stay there."""
        fields = [f.name for f in self.schema]
        spread = self._dealt(rows.select(*fields, self._bucket().alias("bucket")))
        packed = {} if self.fmt == "parquet" else {"compression": "gzip"}
        path = f"{self.path}/data/version={version}"
        spread.write.mode("overwrite").partitionBy("bucket").format(self.fmt).options(**packed).save(path)
        return {int(x) for file in self._load([path]).inputFiles() for x in re.findall(r"/bucket=(\d+)/", file)}

    def _without(self, files: list[str], gone: DataFrame) -> DataFrame:
        """Rows of ``files`` whose key is not in ``gone``. They move once, to where they are compared and then written; those of JSON as the lines they are, which are smaller than their values."""
        gone = self._dealt(gone).hint("shuffle_hash")
        if self.fmt != "json":
            return self._dealt(self._load(files)).join(gone, self.key, "left_anti")
        key = F.from_json("value", T.StructType([self.schema[self.key]]))[self.key].alias(self.key)
        left = self._dealt(self.spark.read.text(files).select(key, "value")).join(gone, self.key, "left_anti")
        return left.select(self.key, F.from_json("value", T.StructType([f for f in self.schema if f.name != self.key])).alias("r")).select(self.key, "r.*")

    def _commit(self, held: dict[int, list[str]]) -> None:
        rows = [(b, versions, self.buckets, self.hash) for b, versions in sorted(held.items())]
        self.spark.createDataFrame(rows, "bucket int, versions array<string>, buckets int, hash string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/seq={self.seq + 1}")

    def append(self, rows: DataFrame, version: str | None = None) -> None:
        """Add rows. A repeat of the last ``version`` changes nothing, so that a repeated batch counts once."""
        version = version or uuid.uuid4().hex
        held = {b: list(v) for b, (v, _) in self.manifest().items()}
        if any(v and v[-1] in (version, f"{version}-whole") for v in held.values()):
            return
        found = self._write(rows, version)
        if not found:
            return
        for b in found:
            held[b] = [*held.get(b, []), version]
        full = {b for b in found if len(held[b]) > MOST_VERSIONS}
        if full:
            merged = f"{version}-whole"
            self._write(self._load(self._files({b: (held[b], 0) for b in full})), merged)
            for b in full:
                held[b] = [merged]
        self._commit(held)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Rows of the keys in ``rows`` (and in ``keys``) make way for ``rows``; all others stay."""
        held, version = self.manifest(), uuid.uuid4().hex
        filled = self._write(rows, version)
        found = set(filled)
        if held or keys is not None:
            # Keys are read from what has been written, so no row is computed or stored twice.
            gone = self._load(self._files({b: ([version], 0) for b in filled})).select(self.key)
            gone = settle((gone if keys is None else gone.unionByName(keys.select(self.key))).distinct())
            found |= self.touched(gone)
        if not found:
            return
        files, rest, kept = self._files(held, found), f"{version}-rest", set()
        if files:
            kept = self._write(self._without(files, gone), rest)
        left = {b: v for b, (v, _) in held.items() if b not in found}
        self._commit({**left, **{b: [v for v, here in ((version, filled), (rest, kept)) if b in here] for b in found}})

    def vacuum(self) -> None:
        """Remove the folders of versions that the manifest no longer names, and older manifests. Readers that began before may lose their files."""
        named = {f"version={v}" for versions, _ in self.manifest().values() for v in versions} | {f"seq={self.seq}"}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for part in ("data", "manifest"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            fs = top.getFileSystem(conf)
            for status in fs.listStatus(top) if fs.exists(top) else []:
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)
