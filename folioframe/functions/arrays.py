"""Helpers over arrays inside one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_starts(lengths) -> Column:
    """Sum of the values before each position."""
    kind = "struct<at:array<int>,total:int>"
    start = F.struct(F.expr("array()").cast("array<int>").alias("at"), F.lit(0).alias("total")).cast(kind)
    step = lambda a, n: F.struct(
        F.concat(a["at"], F.array(a["total"])).alias("at"), (a["total"] + n).alias("total")).cast(kind)
    return F.aggregate(lengths, start, step, lambda a: a["at"])
