"""Queries of the package and the SQL they must agree with."""

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import prepare

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a query over whole tables; ``oracle`` is its SQL, where SQL can say it."""
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
