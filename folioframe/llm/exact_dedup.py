"""Exact dedup by recipes of content-defined chunks, in built-in functions only.

A normalised text is cut where its content says so, so texts that share passages share chunks.
Each chunk gets an identifier: a 64-bit hash, verified by comparing contents. All distinct contents
are grouped once (copies merge before they move); where two contents share a hash, a number tells
them apart. A document is then the ordered list of its chunks' identifiers, under a hundredth of
its length, and everything after that compares and moves such lists only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stage

SPACES = r"[\x20\x09-\x0D]+"


def _bytes_class(remainder: int) -> str:
    """A class of bytes, by a rule that is the same for all scripts: every seventh value."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b % 7 == remainder) + "]"


def chunk_pattern(least: int = 256, most: int = 4096) -> str:
    """A chunk ends behind three bytes of the class, but has ``least`` to ``most`` bytes; the last may be shorter."""
    ends = "".join(_bytes_class(r) for r in (3, 4, 4))
    return f"(?s).{{{least},{most - 1}}}?(?:(?<={ends})|\\z)|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def chunks(text: Column, least: int = 256, most: int = 4096) -> Column:
    """The chunks of a text; its UTF-8 bytes are read one character each, so every script is cut alike."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def recipes(docs: DataFrame, least: int = 256, most: int = 4096, hash_bits: int = 64) -> DataFrame:
    """Stage table with a row for each row of ``docs``: rid, doc_id, text_hash, points, text_sha256, recipe.

    ``recipe`` is the list of verified chunk identifiers. ``hash_bits`` below 64 makes hashes collide, for tests.
    """
    norm = normalised(F.col("text"))
    key = F.xxhash64("c") if hash_bits == 64 else F.pmod(F.xxhash64("c"), F.lit(1 << hash_bits))
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("points"), norm.alias("norm")).select(
        "doc_id", "text_hash", "points", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), least, most).alias("chunks"))
    held = stage(cut.select(F.monotonically_increasing_id().alias("rid"), "*"))
    each = held.select("rid", F.posexplode("chunks").alias("pos", "c")).withColumn("h", key)
    contents = each.select("h", "c").distinct()
    shared = stage(contents.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hashed = F.transform("chunks", lambda c: F.xxhash64(c) if hash_bits == 64 else F.pmod(F.xxhash64(c), F.lit(1 << hash_bits)))
    plain = held.select("rid", "doc_id", "text_hash", "points", "text_sha256", F.transform(hashed, lambda h: F.struct(h.alias("h"), F.lit(0).alias("k"))).alias("recipe"))
    if shared.isEmpty():
        return plain
    # Two contents have one hash: number the contents of each such hash, and put the numbers into the lists.
    numbers = contents.join(shared.select("h"), "h", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("c")) - 1)
    told = each.join(numbers, ["h", "c"], "left").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k")))).alias("told"))
    told = told.select("rid", F.transform("told", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))).alias("told"))
    return stage(plain.join(told, "rid", "left").withColumn("recipe", F.coalesce("told", "recipe")).drop("told"))


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Classes of equal texts of ``docs`` (doc_id, text; further columns are ignored), a row for each row.

    Equal: identical after deleting spaces and the characters 9 to 13. The row with the most code
    points in the original text stays, then the smallest doc_id (null comes last); of rows that
    agree in both, exactly one stays. Null counts as empty; all empty texts are one class.
    Returns doc_id, text_hash (of the original text), keep_id, group_size, kept, text_sha256. An
    empty table gives an empty result.
    """
    rows = recipes(docs, **options)
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("r"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select("doc_id", "text_hash", F.col("best.id").alias("keep_id"), "group_size",
                                              (F.col("rid") == F.col("best.r")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, text_hash), each once, with all their columns, whatever their names."""
    wanted = kept.select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    return found.dropDuplicates(["id", "hash"]).select("row.*")
