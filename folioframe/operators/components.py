"""Connected components of a table of links, by joins alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import settle


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node that links (a, b) reach; a link of a node with itself only names it.

    Each turn a node takes the least label among its own and its neighbours', and then the label of that label, so long
    chains shorten by half or more. It ends when no label changes. Nulls take no part.
    """
    some = links.where("a is not null and b is not null").select("a", "b")
    edges = settle(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp"))
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = state.join(near, "node").select("node", "comp", F.least("comp", "near").alias("least"))
        jump = least.select(F.col("node").alias("least"), F.col("least").alias("far"))
        turned = settle(least.join(jump, "least").select("node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("changed")))
        state = turned.select("node", "comp")
        if turned.where("changed").isEmpty():
            return state
