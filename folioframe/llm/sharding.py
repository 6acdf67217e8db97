"""Sharding by balanced label propagation, in built-in functions only.

Documents are linked by groups (here: equal texts). A group counts as links between all its members,
but pairs are never made: the members' shards are counted once per group, and a document reads its
neighbours' shards from the counts of its groups. Rounds of joins move documents to the shard where
most neighbours are, as far as quotas allow; shard sizes never exceed their share, so a group that is
larger than a shard fills one and goes on to the next. Documents without links fill up the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import drop, ranked, stage

LAW = "rows"
_PARTS = 256


def links_by_text(rows: DataFrame) -> DataFrame:
    """rid, grp for the rows whose ``key`` occurs more than once."""
    several = rows.where("key is not null").groupBy("key").count().where("count > 1").select("key")
    return rows.join(several, "key").select("rid", F.col("key").alias("grp"))


def _wanted(shards: int, open_: list[bool]) -> tuple:
    """The best open shard of a document (its own is always open) as (neighbours there, -distance from the group's first choice, shard)."""
    def of(j):
        near = -F.pmod(F.lit(j) - F.col("first"), F.lit(shards))
        value = F.struct(F.col(f"c{j}").alias("n"), near.alias("near"), F.lit(j).alias("j"))
        return value if open_[j] else F.when(F.col("shard") == j, value)
    return F.greatest(*[of(j) for j in range(shards)]) if shards > 1 else of(0)


def _admitted(movers: DataFrame, quota: dict[int, int]) -> DataFrame:
    """The movers that the quotas of their lanes let in: whole groups by falling gain, the last one in part."""
    flows = movers.groupBy("lane", "grp").agg(F.count("*").alias("m"), F.max("gain").alias("gain"))
    level = F.lit(31) - F.least(F.lit(31), F.floor(F.log2(F.col("gain") + 1)))
    flows = flows.withColumn("part", (level * 64 + F.pmod(F.xxhash64("grp"), F.lit(64))).cast("int"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = flows.groupBy("lane", "part").agg(F.sum("m").alias("sum")).select(
        "lane", "part", F.coalesce(F.sum("sum").over(before("lane", by=["part"])), F.lit(0)).alias("earlier"))
    flows = flows.withColumn("inside", F.coalesce(F.sum("m").over(before("lane", "part", by=["grp"])), F.lit(0))).join(parts, ["lane", "part"])
    room = F.coalesce(*[F.when(F.col("lane") == k, F.lit(v)) for k, v in quota.items()], F.lit(0))
    admit = flows.withColumn("admit", F.least(F.col("m"), room - F.col("earlier") - F.col("inside"))).where("admit > 0").select(
        "lane", "grp", "admit", (F.col("admit") < F.col("m")).alias("in_part"))
    found = movers.join(admit, ["lane", "grp"])
    some = ranked(found.where("in_part"), ["lane"], ["rid"], "place", _PARTS).where("place < admit")
    return found.where("not in_part").select("rid", "to").unionByName(some.select("rid", "to"))


def propagate(members: DataFrame, shards: int, room: list[int], rounds: int) -> DataFrame:
    """rid, shard for all members (rid, grp; a document may be in several groups), at most ``room[j]`` in shard j.

    ``room`` must not rise with j and must hold all members. Rounds with free room and rounds of swaps
    between two shards take turns, until neither moves a document or ``rounds`` are over.
    """
    nodes = members.groupBy("rid").agg(F.min("grp").alias("grp"))
    labels = stage(ranked(nodes, [], ["rid"], "place", _PARTS).select("rid", "grp", F.pmod("place", F.lit(shards)).cast("int").alias("shard")))
    still = 0
    for turn in range(rounds):
        size = dict(labels.groupBy("shard").count().collect())  # a row per shard
        free = [room[j] - size.get(j, 0) for j in range(shards)]
        swap = turn % 2 == 1
        if swap or any(f > 0 for f in free):
            ask = [True] * shards if swap else [f > 0 for f in free]
            placed = members.join(labels.select("rid", "shard"), "rid")
            counts = placed.groupBy("grp").agg(*[F.sum(F.when(F.col("shard") == j, 1).otherwise(0)).alias(f"c{j}") for j in range(shards)])
            scores = members.join(counts, "grp").groupBy("rid").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(shards)])
            state = scores.join(labels, "rid").withColumn("first", F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int"))
            own = F.coalesce(*[F.when(F.col("shard") == j, F.col(f"c{j}")) for j in range(shards)])
            movers = stage(state.withColumn("best", _wanted(shards, ask)).where("best.j != shard").select(
                "rid", "grp", F.col("shard").alias("from"), F.col("best.j").alias("to"), (F.col("best.n") - own).alias("gain")))
            flow = {(r["from"], r["to"]): r["count"] for r in movers.groupBy("from", "to").count().collect()}  # a row per pair of shards
            if swap:
                quota = {i * shards + j: min(n, flow.get((j, i), 0)) for (i, j), n in flow.items()}
                movers_ = movers.withColumn("lane", F.col("from") * shards + F.col("to"))
            else:
                quota = dict(enumerate(free))
                movers_ = movers.withColumn("lane", F.col("to"))
            quota = {k: v for k, v in quota.items() if v > 0}
            moved = 0
            if flow and quota:
                news = stage(_admitted(movers_, quota))
                moved = news.count()
                if moved:
                    newer = stage(labels.join(news, "rid", "left").select("rid", "grp", F.coalesce("to", "shard").alias("shard")))
                    drop(labels)
                    labels = newer
                drop(news)
            drop(movers)
            still = 0 if moved else still + 1
        else:
            still += 1
        if still == 2:
            break
    return labels.select("rid", "shard")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 12, links=links_by_text) -> DataFrame:
    """Put ``docs`` (doc_id, text; further columns are ignored) into shards 0 to ``shards`` - 1.

    The law is ``rows``: shard sizes differ by one document at most. ``links`` gives the groups (rid, grp)
    from the rows (rid, key: a digest of the text). Returns a row per row: doc_id, size (UTF-8 bytes plus
    1), text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null for this law).
    A null text has size 1 and crc 0, and no links; empty texts are equal to each other. Repeated
    rows are equal texts. An empty table gives an empty result.
    """
    raw = F.col("text").cast("binary")
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("key")))
    members = stage(links(rows.select("rid", "key")))
    n = rows.count()
    room = [n // shards + (j < n % shards) for j in range(shards)]
    linked = stage(propagate(members, shards, room, rounds))
    size = dict(linked.groupBy("shard").count().collect())
    rest = ranked(rows.select("rid").join(linked.select("rid"), "rid", "left_anti"), [], ["rid"], "place", _PARTS)
    end, ends = 0, []
    for j in range(shards):
        end += room[j] - size.get(j, 0)
        ends.append(end)
    fill = sum((F.when(F.col("place") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    placed = stage(linked.unionByName(rest.select("rid", fill.alias("shard"))))
    slots = ranked(placed, ["shard"], ["rid"], "slot", _PARTS)
    return rows.join(slots, "rid").select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
