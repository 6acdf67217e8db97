"""Session settings the jobs rely on, and the one place where lineage is cut."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are few bytes but much work: let small stages keep more tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    # Windows and joins on (doc_id, span, page) reuse the partitioning by (doc_id, span).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A task writes one bucket of a settled table, so its rows need no sort by bucket ahead of the write.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Timers and value state of streams (transformWithState) need it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Settings a session takes only when it is built. Large column expressions are put together call by
# call; without recorded call sites that takes half the time.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


# Up to what size a side of a join is broadcast: by its estimate, and as its shuffle has measured it.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def tune(spark: SparkSession) -> SparkSession:
    """Take the settings above. The session's broadcast threshold holds for measured sizes only.

    An estimate goes by the bytes of files, and slim columns take a hundred times less there than as rows: a table of every block would pass for a small
    one and go through the driver.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    held = spark.conf.get(ESTIMATED)
    if not held.startswith("-"):
        if spark.conf.get(MEASURED, None) is None:
            spark.conf.set(MEASURED, held)
        spark.conf.set(ESTIMATED, "-1")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


# The session's own setting: over how many tasks the rows of the corpus at hand are dealt out.
TASKS = "folioframe.tasks"
SPAN = ["doc_id", "span"]


def tasks(spark: SparkSession) -> int:
    """Tasks that rows are dealt out over by ``(doc_id, span)``: as ``plan_tasks`` has set it, else the session's shuffle partitions."""
    return int(spark.conf.get(TASKS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def plan_tasks(spark: SparkSession, n: int) -> int:
    """From now on rows are dealt out over ``n`` tasks, and no shuffle has fewer; a small one is still coalesced."""
    spark.conf.set(TASKS, str(n))
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < n:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def settle(df: DataFrame, by: list | None = None) -> DataFrame:
    """Cut the lineage of a table that several branches read: written once, as compressed columns, to the folder all executors share.

    What reads it opens only the columns it needs. Rows with a span lie in buckets by ``(doc_id, span)``, so page windows, scans and joins by row
    move none of them again; ``by`` names other columns to lie by. A table with columns of no type, which files cannot hold, is a checkpoint instead.
    """
    spark = df.sparkSession
    if "void" in df.schema.simpleString():
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        return df.checkpoint(eager=True)
    number = uuid.uuid4().hex
    name, path = f"settled_{number}", f"{shared_folder(spark).rstrip('/')}/settled-{number}"
    by = by or (SPAN if set(SPAN) <= set(df.columns) else None)
    if by:
        n = tasks(spark)
        df.repartition(n, *by).write.bucketBy(n, *by).format("parquet").options(path=path, compression="zstd").saveAsTable(name)
        return spark.table(name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
