"""The operators of this package applied to whole tables, and their SQL."""

from pyspark.sql import functions as F

from folioframe.llm.decontamination import PASSAGES_SQL, find_passages
from folioframe.llm.exact_dedup import exact_duplicates
from folioframe.llm.language import identify_documents
from folioframe.llm.licenses import findings_sql, license_findings
from folioframe.llm.mixing import mix
from folioframe.llm.near_dedup import near_duplicates
from folioframe.llm.packing import pack
from folioframe.llm.phrases import COLLOCATIONS_SQL, collocations
from folioframe.llm.registry import query, table
from folioframe.llm.sharding import shard_documents
from folioframe.llm.token_counts import apply_edits, with_trees
from folioframe.llm.token_files import token_digest
from folioframe.llm.topk import top_k, usable, whole_numbers
from folioframe.llm.vector_codes import codes_sql, compress

DEDUP_SQL = r"""
with n as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') s from documents)
select doc_id, first(doc_id) over g keep_id, count(*) over (partition by s) group_size, row_number() over g = 1 kept, sha256(s) text_sha256
from n window g as (partition by s order by length(t) desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""


@query("op1_near_dedup")
def near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""


@query("op2_topk", TOPK_SQL)
def topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v"))
    found = top_k(vectors.where("id % 50 = 0"), vectors)
    return found.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")


def document_edits():
    """Three edits of every document: its source over some characters inside, some characters taken from its start, its language at its end."""
    place = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    edit = lambda at, removed, added: F.struct(at.cast("long").alias("place"), removed.cast("long").alias("removed"), added.cast("string").alias("added"))
    length = F.coalesce(F.length("text"), F.lit(0))
    return F.array(edit(place % (length + 1), place % 64, F.concat(F.lit(" "), "source", F.lit(", "))),
                   edit(F.lit(0), place % 16, F.lit("")), edit(length + 100, F.lit(0), F.concat(F.lit("\n"), "lang")))


@query("op3_token_counts")
def token_counts(spark, sf_dir):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", document_edits().alias("edits"))
    counted = apply_edits(with_trees(docs, *ranks), *ranks)
    return counted.select("doc_id", F.col("before").alias("tokens_before"), F.col("after").alias("tokens_after"), F.col("encoded").alias("chars_encoded"),
                          F.length("text").cast("long").alias("chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@query("op4_licenses", findings_sql())
def licenses(spark, sf_dir):
    return license_findings(table(spark, sf_dir, "documents"))


@query("op5_mixing")
def mixing(spark, sf_dir):
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "tokens", "p", "rate", "copies")


@query("op6_sharding")
def sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op7_exact_dedup", DEDUP_SQL)
def exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


@query("op9_token_files")
def token_files(spark, sf_dir):
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_packing")
def packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op8_language")
def language(spark, sf_dir):
    return identify_documents(table(spark, sf_dir, "documents"))


@query("op11_vector_codes", codes_sql())
def vector_codes(spark, sf_dir):
    found = compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


@query("op12_decontamination", PASSAGES_SQL)
def decontamination(spark, sf_dir):
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op13_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
