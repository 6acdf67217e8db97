"""Explaining chains: payload, request, cache, model, and cards aligned to the sentences."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import explain as E
from folioframe.operators.continuation import chain_ids
from folioframe.operators.merges import ROW_KEY
from folioframe.session import settle, tasks

CHAIN = ["doc_id", "chain"]


def members(linear: DataFrame) -> DataFrame:
    """Place and chain of the rows that are in one."""
    rows = linear.withColumns({"injected": F.lit(False), "allow_merges": F.lit(True)}) if "injected" not in linear.columns else linear
    # Chains follow from slim columns; whole rows move only once, to their chains.
    slim = settle(rows.select(*ROW_KEY, "role", "continuation", "injected", "allow_merges"))
    return settle(chain_ids(slim).where("chain is not null").select(*ROW_KEY, "chain"))


def payloads(linear: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Payloads of all chains of a corpus; ``chains`` are its ``members``, where at hand. They lie by chain."""
    rows = linear.join(members(linear) if chains is None else chains, ROW_KEY)
    rows = rows.select(*CHAIN, "page", "ri", "text", "sentences", "footnotes")
    # As many tasks as the corpus needs, however small the shuffle.
    return E.merged_sentences(E.chain_payload(rows.repartition(tasks(linear.sparkSession), *CHAIN)))


def _prompt(texts) -> F.Column:
    return F.concat(E.explain_prompt(F.col("map_json"), texts, F.col("footnotes")), E.language_rule(F.col("language")))


def _key() -> F.Column:
    return E.explain_cache_key(F.col("filename"), F.col("text"), F.col("language"))


def requests(chains: DataFrame, info: DataFrame) -> DataFrame:
    """One request per chain. ``info``: doc_id, filename, language, map_json."""
    texts = F.transform("merged", lambda s: s["text"])
    return chains.where(F.size("merged") > 0).join(info, "doc_id").select(
        "doc_id", "chain", "text", texts.alias("texts"), _key().alias("key"), _prompt(texts).alias("prompt"))


def prepare(linear: DataFrame, info: DataFrame) -> DataFrame:
    """The requests of all chains, settled by key, in the parts their prompts follow from: key, doc_id, chain, texts, footnotes, map_json, language.

    ``info`` as for ``requests``. Texts move twice, to their chain and to their key; boxes of sentences and notes stay behind. What a document gives to a request goes to its
    chains as slim rows.
    """
    n, chains = tasks(linear.sparkSession), members(linear)
    none = F.expr("array()").cast(f"array<{schemas.BBOX}>")
    slim = linear.withColumns({
        "sentences": F.transform("sentences", lambda s: F.struct(s["text"].alias("text"), none.alias("boxes"))),
        "footnotes": F.transform("footnotes", lambda f: F.struct(f["text"].alias("text")))})
    every = chains.select("doc_id", "span", "chain").distinct().select(*CHAIN).repartition(n, "doc_id").distinct()
    given = every.join(info.select("doc_id", "filename", "language", "map_json").repartition(n, "doc_id"), "doc_id").repartition(n, *CHAIN)
    rows = payloads(slim, chains).where(F.size("merged") > 0).join(given, CHAIN)
    texts = F.transform("merged", lambda s: s["text"])
    return settle(rows.select(_key().alias("key"), *CHAIN, texts.alias("texts"), "footnotes", "map_json", "language"), ["key"])


VISUAL = ("figure", "table", "algorithm")


def visual_requests(rows: DataFrame, info: DataFrame) -> DataFrame:
    """One request per figure, table or algorithm: page and box say what to crop from the page, which is left to the caller.

    ``rows``: doc_id, page, role, box, caption_text, of either projection; or merged groups, by ``group_rows``.
    """
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.where(F.col("role").isin(*VISUAL)).join(info, "doc_id").select(
        "doc_id", "page", "role", *box, F.col("caption_text").alias("caption"),
        E.explain_cache_key(F.col("filename"), F.col("caption_text"), F.col("language"), F.col("role"), F.col("page"), box).alias("key"),
        F.concat(E.visual_prompt(F.col("map_json"), F.col("role"), F.col("caption_text")), E.language_rule(F.col("language"))).alias("prompt"))


def group_rows(groups: DataFrame) -> DataFrame:
    """Merged groups, as ``edits.merge_group_members`` resolves them, in the form of rows: their text is the caption of a visual group."""
    return groups.select("doc_id", "page", F.col("result_role").alias("role"), "x0", "y0", "x1", "y1", F.col("text").alias("caption_text"))


def cards(answered: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Answers laid out over the sentences: rows need doc_id, chain, texts and ``parsed``; rows that lie by ``key`` stay there.

    ``asked``: the same rows without answers, where these are cheaper to read again.
    """
    asked = answered if asked is None else asked
    by = [c for c in ("key", *CHAIN) if c in answered.columns]
    items = answered.where("parsed is not null").select(
        *by, "texts", F.posexplode("parsed.sentence_explanations").alias("j", "it")).select(
        *by, "texts", "j", F.col("it.sentence_indices").alias("indices"), F.col("it.quote").alias("quote"),
        F.transform("it.concepts", lambda c: c["term"]).alias("terms"))
    solved = E.resolve_sentences(items).groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("j", "indices", "quote", "resolved"))),
        lambda x: F.struct(x["indices"].alias("indices"), x["quote"].alias("quote"), x["resolved"].alias("resolved"))).alias("items"))
    return E.align_explanations(asked.select(*by, "texts").join(solved, by).drop("key"))


ANSWER = "key string, body string, finish string"


def answers(requests: DataFrame, cache: DataFrame | str, client_factory: Callable, wait: bool = True) -> DataFrame:
    """Good answers (key, body, finish, parsed) to ``requests`` (key, prompt; keys are unique): from the cache, or asked now.

    An answer is good if its status is 2xx and it parses. With a path as cache only good answers are appended to it; the others go to
    ``<path>_errors`` with status and error, and are asked again by a later run, as is a stored answer that does not parse.
    """
    path, spark = (cache if isinstance(cache, str) else None), requests.sparkSession
    n = tasks(spark)
    # Answers move to the requests, which lie by key.
    read = lambda rows: E.parse_model_json(rows.select("key", "body", "finish"), schemas.EXPLAIN_RESPONSE).where("error is null").drop("error").repartition(n, "key").dropDuplicates(["key"])
    if path:
        spark.createDataFrame([], ANSWER).write.mode("append").parquet(path)
        cache = spark.read.schema(ANSWER).parquet(path)
    _, todo = E.cache_lookup(requests, read(cache).select("key"))
    asked = E.score_requests(todo, client_factory, wait=wait).select("key", "status", "body", "finish")
    refused = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("Status "), F.coalesce(F.col("status").cast("string"), F.lit("None"))))
    # Judged where they come in, so that neither the good nor the others are parsed again to be told apart.
    fresh = settle(E.parse_model_json(asked, schemas.EXPLAIN_RESPONSE).select("key", "status", "body", "finish", F.coalesce(refused, "error").alias("error")))
    good = fresh.where("error is null").select("key", "body", "finish")
    if not path:
        return read(cache.select("key", "body", "finish").unionByName(good))
    good.write.mode("append").option("compression", "zstd").parquet(path)
    fresh.where("error is not null").select("key", "status", "body", "finish", "error").write.mode("append").parquet(f"{path}_errors")
    return read(spark.read.schema(ANSWER).parquet(path))


def explain(linear: DataFrame, info: DataFrame, cache: DataFrame | str, client_factory: Callable, wait: bool = True) -> DataFrame:
    """Cards of every chain. Equal requests are asked once; cached answers are not asked again.

    ``cache`` is a table of answers (key, body, finish), or the path of one: then new good answers are
    appended to it before anything reads them, and a later run asks for none of them (see ``answers``). Either way an answer is
    stored before it is used, so no lost executor asks twice for what is stored.
    """
    return explain_prepared(prepare(linear, info), cache, client_factory, wait)


def explain_prepared(asked: DataFrame, cache: DataFrame | str, client_factory: Callable, wait: bool = True) -> DataFrame:
    """As ``explain``, for what ``prepare`` has settled. All requests are answered when it returns; the cards are made when they are read."""
    unique = asked.select("key", _prompt(F.col("texts")).alias("prompt")).groupBy("key").agg(F.min("prompt").alias("prompt"))
    known = answers(unique, cache, client_factory, wait).select("key", "parsed")
    return cards(asked.join(known, "key"), asked)
