"""From chains of paragraphs to model requests, and from model answers back to sentences and boxes."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, types
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.functions import fixed_values as V
from folioframe.functions import text as T
from folioframe.functions.arrays import let, running_starts
from folioframe.operators.continuation import glued
from folioframe.operators.sentences import phrase_boxes

SENTENCES = f"array<{schemas.SENTENCE}>"


def _empty(kind: str):
    return F.expr("array()").cast(kind)


# -- payloads --------------------------------------------------------------------------------------------


def chain_payload(rows: DataFrame) -> DataFrame:
    """One row per chain: glued text, all sentences, members with their offset, boundaries, footnotes.

    Offsets are running sums over the rows of the chain, before these meet in one row.
    """
    before = Window.partitionBy("doc_id", "chain").orderBy("page", "ri").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("sentences")
    members = rows.where("chain is not null").withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("int"))
    part = F.struct("page", "ri", "text", "sentences", F.transform("footnotes", lambda n: n["text"]).alias("notes"), "offset")
    g = members.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    offsets = F.transform("parts", lambda p: F.struct(
        p["page"].alias("page"), p["ri"].alias("ri"), p["offset"].alias("offset"), F.size(p["sentences"]).alias("n")))
    return (
        g.withColumn("members", offsets)
        .select(
            "doc_id", "chain", F.get("members", F.lit(0))["page"].alias("page"), F.get("members", F.lit(0))["ri"].alias("ri"),
            glued(F.transform("parts", lambda p: p["text"])).alias("text"),
            F.flatten(F.transform("parts", lambda p: p["sentences"])).alias("sentences"), "members",
            F.transform(F.slice("members", 2, F.greatest(F.size("members") - 1, F.lit(0))), lambda m: m["offset"]).alias("boundaries"),
            F.filter(F.flatten(F.transform("parts", lambda p: p["notes"])), lambda t: t != "").alias("footnotes"),
        )
    )


def merged_sentences(payloads: DataFrame) -> DataFrame:
    """Add ``merged`` (halves of a sentence split between blocks joined) and ``merged_to_orig``."""
    text = lambda k: F.get("sentences", k)["text"]
    every = F.when(F.size("sentences") > 0, F.sequence(F.lit(0), F.size("sentences") - 1)).otherwise(_empty("array<int>"))
    # Which sentences open a member after the first.
    edges = F.flatten(F.transform("members", lambda m, i: F.when(m["n"] > 0, F.concat(
        F.array(i > 0), F.array_repeat(F.lit(False), m["n"] - 1))).otherwise(_empty("array<boolean>"))))
    # Bound once: inside the lambda it would be made anew for every sentence.
    starts = let(edges, lambda e: F.filter(every, lambda k: (k == 0) | ~F.get(e, k) | ~T.is_split_boundary(text(k - 1), text(k))))
    runs = F.transform("starts", lambda s, i: F.sequence(s, F.coalesce(F.get("starts", i + 1), F.size("sentences")) - 1))

    def join(run):
        halves = F.transform(run, lambda k: F.get("sentences", k))
        whole = T.normalize_text(F.array_join(F.transform(halves, lambda s: s["text"]), " "))
        return F.when(F.size(run) == 1, F.get(halves, F.lit(0))).otherwise(F.struct(
            whole.alias("text"), F.flatten(F.transform(halves, lambda s: s["boxes"])).alias("boxes")))

    return (
        payloads.withColumn("starts", starts).withColumn("merged_to_orig", runs)
        .withColumn("merged", F.transform("merged_to_orig", join)).drop("starts")
    )


def sentence_merge_groups(rows: DataFrame) -> DataFrame:
    """Same decision on flat sentences (doc_id, chain, k, text, at_boundary): adds the group number ``m``."""
    w = Window.partitionBy("doc_id", "chain").orderBy("k")
    split = F.col("at_boundary") & T.is_split_boundary(F.lag("text").over(w), "text")
    return rows.withColumn("new", ~F.coalesce(split, F.lit(False))).withColumn(
        "m", (F.sum(F.col("new").cast("int")).over(w) - 1).cast("int")
    ).drop("new")


def merged_to_original(indices, merged_to_orig) -> F.Column:
    fan = F.transform(indices, lambda m: F.coalesce(F.get(merged_to_orig, m), F.array(m)))
    return F.array_sort(F.array_distinct(F.flatten(fan)))


def localize(indices, offset, n) -> F.Column:
    return F.transform(F.filter(indices, lambda i: (i >= offset) & (i < offset + n)), lambda i: i - offset)


# -- matching an answer to its sentences -----------------------------------------------------------------


def valid_indices(indices, n) -> F.Column:
    return F.filter(F.coalesce(indices, _empty("array<int>")), lambda i: (i >= 0) & (i < n))


def _share(words, hay):
    return F.size(F.filter(words, lambda w: F.contains(hay, w))) / F.size(words)


def indices_agree_with_quote(sentences, indices, quote) -> F.Column:
    said = T.normalize_for_match(F.array_join(F.transform(indices, lambda i: F.get(sentences, i)), " "))
    wanted, words = T.normalize_for_match(quote), T.significant_words(quote)
    agrees = ((wanted != "") & F.contains(said, wanted)) | F.when(F.size(words) > 0, _share(words, said) >= 0.7).otherwise(False)
    return (F.size(indices) > 0) & (F.coalesce(quote, F.lit("")) != "") & agrees


def _literal(sentences, quote):
    """Sentences a literal quote covers, compared without hyphens and runs of spaces.

    Normalising is additive over sentences, so lengths tell where each sentence lies in the whole.
    """
    lengths = F.transform(sentences, lambda s: F.length(T.normalize_for_match(F.concat(s, F.lit(" ")))))
    whole, wanted = T.normalize_for_match(F.array_join(sentences, " ")), T.normalize_for_match(quote)
    found = F.when(wanted != "", F.instr(whole, wanted) - 1).otherwise(-1)
    held = F.struct(found.alias("at"), (found + F.length(wanted) - 1).alias("last"), running_starts(lengths).alias("starts"))

    def covered(h):
        def hit(s, k):
            start = F.get(h["starts"], k)
            return F.when((h["at"] < start + F.length(T.normalize_for_match(s))) & (h["last"] >= start), k)

        return F.when(h["at"] >= 0, F.filter(F.transform(sentences, hit), lambda k: k.isNotNull()))

    return let(held, covered)


def _window(sentences, source, declared):
    """Smallest run of at most five sentences with 60 % of the meaningful words, declared ones first."""
    held = F.struct(
        T.significant_words(source).alias("words"), F.transform(sentences, T.normalize_for_match).alias("norms"), declared.alias("declared"))

    def best_of(h):
        need = F.ceil(F.size(h["words"]) * 0.6)

        def of(s):
            def run(d):
                text = F.slice(h["norms"], s + 1, d + 1)
                hits = F.size(F.filter(h["words"], lambda w: F.exists(text, lambda t: F.contains(t, w))))
                near = F.exists(h["declared"], lambda i: (i >= s) & (i <= s + d))
                return F.struct((~near).cast("int").alias("far"), d.alias("d"), (-hits).alias("h"), s.alias("s"))

            room = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda d: s + d < F.size(h["norms"]))
            return F.filter(F.transform(room, run), lambda x: -x["h"] >= need)

        starts = F.sequence(F.lit(0), F.size(h["norms"]) - 1)
        return F.when(F.size(h["words"]) > 0, F.array_min(F.flatten(F.transform(starts, of))))

    return let(let(held, best_of), lambda b: F.when(b.isNotNull(), F.sequence(b["s"], b["s"] + b["d"])))


def resolve_sentences(items: DataFrame) -> DataFrame:
    """Add ``tier`` and ``resolved`` to answers; rows need ``texts`` (sentences), ``indices``, ``quote``
    and ``terms`` (concept terms). The stages: declared indices that agree with the quote, the literal
    quote, the best window of sentences, the declared indices as they are."""
    has_quote = F.coalesce(F.col("quote"), F.lit("")) != ""
    source = F.when(has_quote, F.col("quote")).otherwise(F.array_join(F.coalesce("terms", _empty("array<string>")), " "))
    items = items.withColumn("clean", valid_indices(F.col("indices"), F.size("texts"))).withColumn(
        "agrees", indices_agree_with_quote(F.col("texts"), F.col("clean"), F.col("quote")))
    items = items.withColumn("literal", F.when(~F.col("agrees") & has_quote, _literal(F.col("texts"), F.col("quote"))))
    items = items.withColumn("literal", F.when(F.size("literal") > 0, F.col("literal")))
    items = items.withColumn("fuzzy", F.when(
        ~F.col("agrees") & F.col("literal").isNull() & (F.size("texts") > 0), _window(F.col("texts"), source, F.col("clean"))))
    tier = F.when(F.col("agrees"), 1).when(F.col("literal").isNotNull(), 2).when(F.col("fuzzy").isNotNull(), 3).otherwise(4)
    resolved = F.when(F.col("agrees"), F.col("clean")).otherwise(F.coalesce("literal", "fuzzy", "clean"))
    return items.withColumn("tier", F.when(F.size("texts") > 0, tier).otherwise(4)).withColumn(
        "resolved", F.when(F.size("texts") > 0, resolved).otherwise(_empty("array<int>"))
    ).drop("clean", "agrees", "literal", "fuzzy")


def align_explanations(answers: DataFrame) -> DataFrame:
    """One row per card: rows need ``texts`` and ``items`` array<struct<indices, quote, resolved>>.

    The first item to claim a sentence keeps it and shows at its first sentence; sentences nobody claims
    become placeholders; items without any valid index come last.
    """
    n = F.size("texts")
    every = F.sequence(F.lit(0), n - 1)
    claims = F.transform(every, lambda k: F.array_min(F.filter(F.transform(
        "items", lambda it, j: F.when(F.array_contains(it["resolved"], k), j)), lambda j: j.isNotNull())))

    def card(k):
        me = F.get("claims", k)
        fresh = me.isNull() & ((k == 0) | F.get("claims", k - 1).isNotNull())
        rest = F.slice("claims", k + 1, n - k)
        stop = F.array_position(F.transform(rest, lambda c: c.isNotNull()), True).cast("int")
        end = F.when(stop > 0, k + stop - 2).otherwise(n - 1)
        gap = F.sequence(k, end)
        return F.when(me.isNotNull() & (F.array_position("claims", me) == k + 1), F.struct(
            k.alias("at"), me.alias("item"), F.get("items", me)["indices"].alias("indices"),
            F.get("items", me)["quote"].alias("quote"), F.lit(False).alias("is_placeholder"))
        ).when(fresh, F.struct(
            k.alias("at"), F.lit(None).cast("int").alias("item"), gap.alias("indices"),
            F.array_join(F.transform(gap, lambda i: F.get("texts", i)), " ").alias("quote"), F.lit(True).alias("is_placeholder")))

    shown = F.filter(F.transform(every, card), lambda c: c.isNotNull())
    lost = F.filter(F.transform("items", lambda it, j: F.when(
        (F.array_position("claims", j) == 0) & (F.size(valid_indices(it["indices"], n)) == 0),
        F.struct((n + j).alias("at"), j.alias("item"), it["indices"].alias("indices"), it["quote"].alias("quote"),
                 F.lit(False).alias("is_placeholder")))), lambda c: c.isNotNull())
    return (
        answers.where(n > 0).withColumn("claims", claims)
        .select(*[c for c in answers.columns if c not in ("texts", "items")], F.posexplode(F.concat(shown, lost)).alias("slot", "c"))
        .select("*", "c.item", "c.indices", "c.quote", "c.is_placeholder").drop("c")
    )


# -- requests and answers --------------------------------------------------------------------------------


def djb2_base36(c) -> F.Column:
    """32-bit xor hash over UTF-16 units, in base 36."""
    units = F.transform(
        F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)),
        lambda u: F.conv(u, 16, 10).cast("bigint"),
    )
    h = F.aggregate(units, F.lit(5381).cast("bigint"), lambda a, u: (a * 33).bitwiseXOR(u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def number_text(c) -> F.Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def explain_cache_key(filename, text, language, role=None, page=None, box=None, prefix: str = "explain:v3") -> F.Column:
    tag = text
    if role is not None:
        visual = F.concat_ws(":", role, page.cast("string"), F.concat_ws(",", *[number_text(b) for b in box]))
        tag = F.when(role.isin("figure", "table", "algorithm"), visual).otherwise(text)
    return F.concat_ws(":", F.lit(prefix), F.coalesce(language, F.lit(V.DEFAULT_LANGUAGE)), filename, djb2_base36(tag))


def number_sentences(texts) -> F.Column:
    return F.array_join(F.transform(texts, lambda s, i: F.concat(F.lit("[S"), i.cast("string"), F.lit("] "), s)), "\n")


def language_rule(language, wording: str = "Language of all values but verbatim quotes: {}.") -> F.Column:
    """The last line of a request, which says in what language to answer; the wording belongs to the user."""
    before, after = wording.split("{}")
    return F.concat(F.lit("\n\n" + before), T.language_name(F.coalesce(language, F.lit(V.DEFAULT_LANGUAGE))), F.lit(after))


def explain_prompt(map_json, texts, footnotes, labels=("Map:", "Paragraph:", "Footnotes:")) -> F.Column:
    """Request text of a paragraph, without its language rule; the wording of the labels belongs to the user."""
    notes = F.array_join(F.transform(footnotes, lambda f: F.concat(F.lit("[Footnote] "), f)), "\n")
    base = F.concat(F.lit(labels[0] + "\n"), map_json, F.lit(f"\n\n{labels[1]}\n"), number_sentences(texts))
    return F.when(F.size(footnotes) > 0, F.concat(base, F.lit(f"\n\n{labels[2]}\n"), notes)).otherwise(base)


def concept_prompt(map_json, texts, selected, labels=("Map:", "Context:", "Selection:"), no_context="(none)") -> F.Column:
    context = F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(no_context)
    return F.concat(
        F.lit(labels[0] + "\n"), map_json, F.lit(f"\n\n{labels[1]}\n"), context, F.lit(f"\n\n{labels[2]}\n"), T.strip(selected)
    )


def visual_prompt(map_json, role, caption, labels=("Map:", "Kind:", "Caption:"), no_caption="(none)") -> F.Column:
    """What goes with the picture of a figure, table or algorithm."""
    said = F.when(T.strip(caption) != "", T.strip(caption)).otherwise(no_caption)
    return F.concat(F.lit(labels[0] + "\n"), map_json, F.lit(f"\n\n{labels[1]}\n"), role, F.lit(f"\n\n{labels[2]}\n"), said)


def _whole(value, kind) -> F.Column:
    """Whether a parsed value has every field of its type, in every element."""
    if isinstance(kind, types.StructType):
        return reduce(lambda a, b: a & b, [_whole(value[f.name], f.dataType) for f in kind], value.isNotNull())
    if isinstance(kind, types.ArrayType):
        return value.isNotNull() & F.coalesce(F.forall(value, lambda x: _whole(x, kind.elementType)), F.lit(False))
    return value.isNotNull()


def parse_model_json(rows: DataFrame, schema: str, body="body", finish="finish") -> DataFrame:
    """Add ``parsed`` and ``error``: empty answer, cut off, invalid JSON, an answer without all fields of the schema, or fine."""
    ended = F.element_at(F.split(F.col(finish), r"\."), -1)
    empty = F.coalesce(F.col(body), F.lit("")) == ""
    cut = F.coalesce(F.col(finish), F.lit("")) != ""
    cut = cut & ~ended.isin("STOP", "1")
    # Followed by one more element, the body parses as an array of two only if it is one whole JSON value.
    strict = {"allowSingleQuotes": "false"}
    pair = F.from_json(F.concat(F.lit("["), F.col(body), F.lit(",0]")), "array<string>", strict)
    valid = F.coalesce(F.size(pair) == 2, F.lit(False))
    error = (
        F.when(empty, F.concat(F.lit("Empty response (finish_reason="), F.coalesce(finish, F.lit("None")), F.lit(")")))
        .when(cut, F.concat(F.lit("Response truncated (finish_reason="), F.col(finish), F.lit(")")))
        .when(~valid, F.concat(F.lit("Invalid JSON (finish_reason="), F.coalesce(finish, F.lit("None")), F.lit(")")))
    )
    read = rows.withColumn("error", error).withColumn("parsed", F.when(F.col("error").isNull(), F.from_json(body, schema, strict)))
    fits = F.ltrim(F.col(body)).startswith("{") & _whole(F.col("parsed"), types.DataType.fromDDL(schema))
    lacking = F.concat(F.lit("Invalid answer (finish_reason="), F.coalesce(finish, F.lit("None")), F.lit(")"))
    read = read.withColumn("error", F.when(F.col("error").isNull() & ~F.coalesce(fits, F.lit(False)), lacking).otherwise(F.col("error")))
    return read.withColumn("parsed", F.when(F.col("error").isNull(), F.col("parsed")))


def cache_lookup(requests: DataFrame, cache: DataFrame, also: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(answered with the stored response, still to compute); keys are unique in the cache.

    A key holds 32 bits of its text, so among many requests different texts share one. ``also`` names columns of both sides, such as
    the text, that must agree too; key and these together are unique in the cache then.
    """
    on = ["key", *also]
    return requests.join(cache, on), requests.join(cache, on, "left_anti")


def score_requests(requests: DataFrame, client_factory: Callable, attempts: int = V.MAX_ATTEMPTS, wait: bool = True, parallel: int = 8, tasks: int | None = None) -> DataFrame:
    """Ask the user's client once per request. ``client_factory()`` is built once per thread and gives a
    function prompt -> (status, body, finish). A network failure (ConnectionError) is tried again; any other error of the client
    becomes a row without status that names it in ``finish``. ``parallel`` requests of a partition wait at a time; ``tasks`` deals the
    requests out evenly, since their work does not follow their bytes."""
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    retryable = set(V.RETRYABLE_STATUSES)

    def ask(client, prompt):
        for n in range(1, attempts + 1):
            try:
                status, body, finish = client(prompt)
            except ConnectionError:
                status, body, finish = None, None, None
            except Exception as e:  # one request must not end the job
                return None, None, f"client error: {type(e).__name__}: {e}", n
            if (status is not None and status not in retryable) or n == attempts:
                return status, body, finish, n
            if wait:
                time.sleep(2 ** (n - 1))

    def run(batches):
        own = threading.local()

        def one(prompt):
            if not hasattr(own, "client"):
                own.client = client_factory()
            return ask(own.client, prompt)

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                got = list(pool.map(one, batch["prompt"]))
                yield batch.assign(**{
                    "status": pd.array([g[0] for g in got], dtype="Int32"), "body": [g[1] for g in got],
                    "finish": [g[2] for g in got], "attempts": pd.array([g[3] for g in got], dtype="Int32")})

    answer = "status int, body string, finish string, attempts int"
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    requests = requests if tasks is None else requests.repartition(tasks)
    return requests.mapInPandas(run, f"{given}, {answer}")


# -- concepts --------------------------------------------------------------------------------------------


def _norm(c):
    return T.normalize_text(F.coalesce(c, F.lit("")))


def locate_fragment(items, fragment) -> F.Column:
    """Numbers of the cards a fragment covers, found in their quotes joined in reading order."""
    refs = F.filter(
        F.transform(items, lambda it, i: F.struct(i.alias("i"), _norm(it["quote"]).alias("q"), F.coalesce(it["forced"], F.lit(False)).alias("f"))),
        lambda r: ~r["f"] & (r["q"] != ""))

    def covered(held):
        quotes, target = held["refs"], held["target"]
        at = F.when(target != "", F.instr(F.array_join(F.transform(quotes, lambda r: r["q"]), " "), target) - 1).otherwise(-1)

        def hit(r, k, pos):
            start = F.aggregate(F.slice(quotes, 1, k), F.lit(0), lambda a, x: a + F.length(x["q"]) + 1)
            return F.when((pos >= 0) & (pos < start + F.length(r["q"])) & (pos + F.length(target) > start), r["i"])

        return let(at, lambda pos: F.filter(F.transform(quotes, lambda r, k: hit(r, k, pos)), lambda i: i.isNotNull()))

    return let(F.struct(refs.alias("refs"), _norm(fragment).alias("target")), covered)


def concepts_distinct(existing, new) -> F.Column:
    """``new`` without the terms already present, whatever their case."""
    have = F.transform(F.coalesce(existing, F.slice(new, 1, 0)), lambda c: F.lower(F.coalesce(c["term"], F.lit(""))))
    return F.filter(new, lambda c: ~F.array_contains(have, F.lower(F.coalesce(c["term"], F.lit("")))))


def _by_appearance(concepts, hay):
    keyed = F.transform(concepts, lambda c, i: F.struct(
        F.when(F.instr(hay, F.lower(_norm(c["term"]))) > 0, F.instr(hay, F.lower(_norm(c["term"])))).otherwise(2**31 - 1).alias("at"),
        i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


CARD = f"struct<sentence_indices:array<int>,quote:string,concepts:array<{schemas.CONCEPT}>,forced:boolean,is_placeholder:boolean>"


def _fused(touched, new) -> F.Column:
    """One card from the covered ones: indices united, quotes joined, concepts distinct and in order."""
    lower = lambda c: F.lower(F.coalesce(c["term"], F.lit("")))
    single = F.size(touched) == 1
    none = F.slice(new, 1, 0)

    def dedup(old):
        def by_term(terms):
            return F.filter(F.transform(old, lambda c, i: F.when(
                single | (F.array_position(terms, lower(c)) == i + 1), c)), lambda c: c.isNotNull())

        return let(F.transform(old, lower), by_term)

    def card(quote, kept):
        united = F.array_sort(F.array_distinct(F.flatten(F.transform(
            touched, lambda t: F.coalesce(t["sentence_indices"], _empty("array<int>"))))))
        ordered = let(F.lower(_norm(quote)), lambda hay: _by_appearance(F.concat(kept, concepts_distinct(kept, new)), hay))
        return F.struct(
            F.when(single, F.get(touched, F.lit(0))["sentence_indices"]).otherwise(united).alias("sentence_indices"),
            quote.alias("quote"), ordered.alias("concepts"), F.lit(False).alias("forced"), F.lit(False).alias("is_placeholder"))

    quote = F.array_join(F.transform(touched, lambda t: t["quote"]), " ")
    old = F.flatten(F.transform(touched, lambda t: F.coalesce(t["concepts"], none)))
    return let(let(old, dedup), lambda kept: let(quote, lambda q: card(q, kept)))


def inject_concepts(cards: DataFrame) -> DataFrame:
    """Put ``new_concepts`` found in ``fragment`` on the card(s) it covers; adds ``covered``, replaces ``items``.

    Several covered cards become one; without a covered card the concepts get a card at the end.
    """
    trailing = F.struct(
        _empty("array<int>").alias("sentence_indices"), F.col("fragment").alias("quote"), F.col("new_concepts").alias("concepts"),
        F.lit(True).alias("forced"), F.lit(False).alias("is_placeholder"))

    def rebuilt(covered):
        touched = F.transform(covered, lambda i: F.get("items", i))
        return let(let(touched, lambda t: _fused(t, F.col("new_concepts"))), lambda card: F.filter(F.transform(
            "items", lambda it, i: F.when(i == F.array_min(covered), card).when(~F.array_contains(covered, i), it)), lambda c: c.isNotNull()))

    def renewed(covered):
        items = F.when(F.size(covered) == 0, F.concat("items", F.array(trailing))).otherwise(rebuilt(covered))
        return F.struct(covered.alias("covered"), items.cast(f"array<{CARD}>").alias("items"))

    out = cards.withColumn("_new", let(locate_fragment(F.col("items"), F.col("fragment")), renewed))
    return out.withColumns({"covered": F.col("_new.covered"), "items": F.col("_new.items")}).drop("_new")


def concept_boxes(cards: DataFrame) -> DataFrame:
    """Boxes of each concept term in the sentence it belongs to: rows need ``sentence`` and ``term``."""
    return cards.withColumn("term_boxes", phrase_boxes(F.col("sentence"), F.col("term")))


_MATH = r"(?s)\\\$|\$\$(?!\$\$).+?\$\$|\\\[(?!\\\]).+?\\\]|\\\((?!\\\)).+?\\\)|\$[^$]+\$|[^\\$]+|."


def tokenize_math(c) -> F.Column:
    """array<struct<type, value, display>>: text and math pieces in order; ``\\$`` is a plain dollar.

    Pieces of text next to each other are one token. A token starts at each formula and at each text that has no text before it.
    """
    def piece(t):
        inner = lambda k: F.substring(t, k + 1, F.length(t) - 2 * k)
        math = lambda v, d: F.struct(F.lit("math").alias("type"), v.alias("value"), F.lit(d).alias("display"))
        two = F.length(t) > 2
        return (
            F.when(two & t.startswith("$$") & (F.length(t) > 4), math(inner(2), True))
            .when(two & t.startswith("\\["), math(inner(2), True)).when(two & t.startswith("\\("), math(inner(2), False))
            .when(two & t.startswith("$"), math(inner(1), False))
            .otherwise(F.struct(F.lit("text").alias("type"), F.when(t == "\\$", "$").otherwise(t).alias("value"), F.lit(False).alias("display")))
        )

    def tokens(pieces):
        is_text = lambda i: F.get(pieces, i)["type"] == "text"
        places = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1)).otherwise(_empty("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | ~is_text(i) | ~is_text(i - 1))

        def cut(at):
            def token(i, k):
                run = F.slice(pieces, i + 1, F.coalesce(F.get(at, k + 1), F.size(pieces)) - i)
                whole = F.array_join(F.transform(run, lambda p: p["value"]), "")
                first = F.get(pieces, i)
                return F.struct(first["type"].alias("type"), whole.alias("value"), first["display"].alias("display"))

            return F.transform(at, token)

        return let(starts, cut)

    return let(F.transform(F.regexp_extract_all(c, F.lit(_MATH), F.lit(0)), piece), tokens)
