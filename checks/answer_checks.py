"""Answers matched to sentences, reader edits, jobs, the store of documents, and whole plans."""

import uuid

from pyspark.sql import functions as F

from checks import sqlkit as K
from checks import whole_sql as WS
from checks.flow_checks import (
    _PIN, _SENTS, BOX, CHAINS, GLUED, LINEAR_FLOW, MERGED, PLAIN, _caption_fold, _caption_rows, _recursive, chained_rows, flowed_pages, linear_flow, plain_linear, plain_pages, whole_rows)
from checks.registry import bronze, check, shared, table
from checks.text_checks import _B36, _text_hash, significant_sql
from folioframe.functions import text as T
from folioframe.functions.arrays import let
from folioframe.operators import edits as D
from folioframe.operators import explain as E
from folioframe.operators import jobs as J
from folioframe.operators import merges as M
from folioframe.plans import analyze as PA
from folioframe.plans import explain as PE
from folioframe.plans import extract as X
from folioframe.plans import reader as PR
from folioframe.session import settle, shared_folder
from folioframe.sources import catalog

# -- answers ---------------------------------------------------------------------------------------------


@shared
def sample_answers(spark, sf_dir):
    """Answers derived from the merged sentences of each chain: one item per sentence, quoting the middle of a
    sentence that is not always the one declared, sometimes hyphenated, sometimes paraphrased."""
    chains = E.merged_sentences(E.chain_payload(chained_rows(spark, sf_dir)))
    d, n = F.col("doc_id"), F.size("texts")
    rows = settle(chains.select("doc_id", "chain", F.transform("merged", lambda s: s["text"]).alias("texts"))).where(n > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    said = F.get("texts", (F.col("j") + d % 2).cast("int") % n)
    words = F.slice(F.split(said, " "), 2, 5)
    cut = F.transform(words, lambda w, i: F.when((i == 1) & (d % 3 == 0) & (F.length(w) > 3), F.concat(F.substring(w, 1, 2), F.lit("- "), F.substr(w, F.lit(3)))).otherwise(w))
    mixed = F.filter(F.transform(cut, lambda w, i: F.when((d % 5 == 1) & (i == 2), "zzzz").otherwise(w)), lambda w: w != "")
    return settle(rows.select(
        "doc_id", "chain", "j", "texts", F.array(F.when(F.col("j") == 3, n + 3).otherwise(F.col("j"))).alias("indices"),
        F.array_join(mixed, " ").alias("quote"), F.array().cast("array<string>").alias("terms")))


def _n(t):
    return f"regexp_replace(replace(regexp_replace(lower({t}), {K.q('-' + K.S + '*')}, '', 'g'), chr(173), ''), {K.q(K.S + '+')}, ' ', 'g')"


ANSWERS = f"""
mt as (select doc_id, chain, m, case when count(*) = 1 then min(text) else {K.norm('string_agg(text, chr(32) order by idx)')} end text from ms group by doc_id, chain, m),
ct as (select doc_id, chain, list(text order by m) ts, count(*)::int n from mt group by doc_id, chain),
an0 as (select *, unnest(range(n))::int j from ct),
an1 as (select *, string_split(ts[((j + doc_id % 2) % n)::int + 1], ' ')[2:6] ws, case when j = 3 then n + 3 else j end decl from an0),
an2 as (select *, list_transform(ws, lambda w, i: case when doc_id % 5 = 1 and i = 3 then 'zzzz' when i = 2 and doc_id % 3 = 0 and length(w) > 3 then left(w, 2) || '- ' || substr(w, 3) else w end) ws2 from an1),
an as (select doc_id, chain, j, ts, n, decl, array_to_string(list_filter(ws2, lambda w: w <> ''), ' ') quote from an2),
nm as (select doc_id, chain, m, text, {_n("text || ' '")} nt, {_n('text')} ne from mt),
nl as (select *, coalesce(sum(length(nt)) over (partition by doc_id, chain order by m rows between unbounded preceding and 1 preceding), 0) a from nm),
nw as (select doc_id, chain, {_n("string_agg(text, ' ' order by m)")} whole from mt group by doc_id, chain),
r0 as (select an.*, {_n('quote')} nq, list_distinct({significant_sql('quote')}) sw, {_n('ts[decl + 1]')} nd from an),
r1 as (select r0.*, whole, decl < n and quote <> '' and ((nq <> '' and contains(nd, nq)) or (len(sw) > 0 and len(list_filter(sw, lambda w: contains(nd, w))) / len(sw) >= 0.7)) agrees from r0 join nw using (doc_id, chain)),
r2 as (select r1.*, case when nq <> '' and contains(whole, nq) then instr(whole, nq) - 1 end loc from r1),
lit as (select r2.doc_id, r2.chain, r2.j, list(m order by m) ids from r2 join nl using (doc_id, chain) where loc is not null and loc < a + length(ne) and loc + length(nq) - 1 >= a group by all),
win as (select r2.doc_id, r2.chain, r2.j, s.m s, d, not (decl between s.m and s.m + d) far, len(list_filter(sw, lambda w: exists(select 1))) h from r2 join nl s using (doc_id, chain), range(5) g(d) where false),
hitw as (select r2.doc_id, r2.chain, r2.j, nl.m, unnest(sw) w, ne from r2 join nl using (doc_id, chain) where not agrees and len(sw) > 0),
hits as (select doc_id, chain, j, m, w from hitw where contains(ne, w)),
cw as (select r2.doc_id, r2.chain, r2.j, s.m s, g.d::int d, n, decl, len(sw) k from r2 join nl s using (doc_id, chain), range(5) g(d) where not agrees and len(sw) > 0 and s.m + g.d < n),
cwh as (select cw.doc_id, cw.chain, cw.j, s, d, k, (decl not between s and s + d)::int far, count(distinct h.w) h from cw left join hits h on h.doc_id = cw.doc_id and h.chain = cw.chain and h.j = cw.j and h.m between s and s + d group by all),
best as (select doc_id, chain, j, arg_min(s, {{'f': far, 'd': d, 'h': -h, 's': s}}) s, arg_min(d, {{'f': far, 'd': d, 'h': -h, 's': s}}) d from cwh where h >= ceil(k * 0.6) group by all),
solved as (select r2.doc_id, r2.chain, r2.j, r2.n, r2.decl, r2.quote, case when agrees then 1 when lit.ids is not null then 2 when best.s is not null then 3 else 4 end tier,
   case when agrees then [decl] when lit.ids is not null then lit.ids when best.s is not null then range(best.s, best.s + best.d + 1) when decl < n then [decl] else [] end::int[] ids
   from r2 left join lit using (doc_id, chain, j) left join best using (doc_id, chain, j))"""
ANSWERS = "\n".join(line for line in ANSWERS.split("\n") if not line.startswith("win as"))
_ALL = (PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, MERGED, ANSWERS)


@check("resolved_sentences", K.sql("select doc_id, chain, j, tier, array_to_string(ids, ',') resolved from solved", *_ALL))
def resolved_sentences(spark, sf_dir):
    r = E.resolve_sentences(sample_answers(spark, sf_dir))
    return r.select("doc_id", "chain", "j", "tier", F.array_join(F.transform("resolved", lambda k: k.cast("string")), ",").alias("resolved"))


@check("indices_agree", K.sql("select doc_id, chain, j, agrees from r1", *_ALL))
def indices_agree(spark, sf_dir):
    a = sample_answers(spark, sf_dir)
    clean = E.valid_indices(F.col("indices"), F.size("texts"))
    return a.select("doc_id", "chain", "j", E.indices_agree_with_quote(F.col("texts"), clean, F.col("quote")).alias("agrees"))


@check("aligned_explanations", K.sql("""select doc_id, chain, (row_number() over (partition by doc_id, chain order by pos) - 1)::int slot, item, indices, quote, is_placeholder from (
   select doc_id, chain, m pos, item, decl::varchar indices, quote, false is_placeholder from (select c.*, s.decl, s.quote, min(m) over (partition by c.doc_id, c.chain, item) fm from cl c join solved s on s.doc_id = c.doc_id and s.chain = c.chain and s.j = c.item) where m = fm
   union all select doc_id, chain, min(m), null, string_agg(m::varchar, ',' order by m), string_agg(text, ' ' order by m), true from
     (select *, m - row_number() over (partition by doc_id, chain order by m) isl from cl where item is null) group by doc_id, chain, isl
   union all select doc_id, chain, n + j, j, decl::varchar, quote, false from solved s where decl >= n and not exists (select 1 from cl where cl.doc_id = s.doc_id and cl.chain = s.chain and cl.item = s.j))""",
   *_ALL, "cl as (select mt.doc_id, mt.chain, mt.m, mt.text, min(s.j) item from mt left join solved s on s.doc_id = mt.doc_id and s.chain = mt.chain and list_contains(s.ids, mt.m) group by all)"))
def aligned_explanations(spark, sf_dir):
    r = E.resolve_sentences(sample_answers(spark, sf_dir))
    items = F.transform(F.array_sort(F.collect_list(F.struct("j", "indices", "quote", "resolved"))), lambda x: F.struct(x["indices"], x["quote"], x["resolved"]))
    rows = settle(r.groupBy("doc_id", "chain").agg(F.first("texts").alias("texts"), items.alias("items")))
    return E.align_explanations(rows).withColumn("indices", F.array_join(F.transform("indices", lambda k: k.cast("string")), ","))


@check("indices_to_blocks", K.sql("""select doc_id, chain, ri, string_agg((idx - off)::varchar, ',' order by idx) own from (select *, min(idx) over (partition by doc_id, chain, ri) off from ms) group by doc_id, chain, ri""",
                                  PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, MERGED))
def indices_to_blocks(spark, sf_dir):
    """Every merged sentence, back to the sentences of each member block."""
    p = E.merged_sentences(E.chain_payload(chained_rows(spark, sf_dir)))
    every = F.transform("merged", lambda s, i: i)
    joined = lambda own: F.array_join(F.transform(own, lambda k: k.cast("string")), ",")
    # A member takes its own part before members become rows, so no row holds the numbers of the whole chain.
    own = let(E.merged_to_original(every, F.col("merged_to_orig")), lambda idx: F.transform("members", lambda m: F.struct(
        m["ri"].alias("ri"), joined(E.localize(idx, m["offset"], m["n"])).alias("own"))))
    return p.select("doc_id", "chain", F.inline(own)).where("own <> ''")


def _cards(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null")
    card = F.struct(F.array(F.col("turn").cast("int")).alias("sentence_indices"), F.col("text").alias("quote"),
                    F.array(F.struct(F.regexp_extract("text", r"(\S+)", 1).alias("term"), F.lit("x").alias("explanation"))).alias("concepts"),
                    (F.col("turn") % 5 == 4).alias("forced"), F.lit(True).alias("is_placeholder"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", card.alias("c")))).alias("cs"))
    first, second = F.get("cs", F.lit(0))["c"]["quote"], F.get("cs", F.lit(1))["c"]["quote"]
    tail, head = F.right(T.normalize_text(first), F.lit(4)), F.left(T.normalize_text(second), F.lit(4))
    fragment = F.when(F.col("conv_id") % 3 == 0, "nowhere at all").when(
        (F.col("conv_id") % 3 == 1) & second.isNotNull(), F.concat_ws(" ", tail, head)).otherwise(tail)
    new = F.array(F.struct(F.lit("NEW").alias("term"), F.lit("y").alias("explanation")),
                  F.struct(F.regexp_extract(first, r"(\S+)", 1).alias("term"), F.lit("z").alias("explanation")))
    return settle(g.select("conv_id", F.transform("cs", lambda x: x["c"]).alias("items"), fragment.alias("fragment"), new.alias("new_concepts")))


_CARDS = f"""with t0 as (select conv_id, turn, {K.norm('text')} q, row_number() over (partition by conv_id order by turn, text) - 1 i, turn % 5 = 4 forced from conversations where text is not null),
  f0 as (select conv_id, max(q) filter (i = 0) a, max(q) filter (i = 1) b from t0 group by all),
  f as (select conv_id, {K.norm("case when conv_id % 3 = 0 then 'nowhere at all' when conv_id % 3 = 1 and b is not null then right(a, 4) || ' ' || left(b, 4) else right(a, 4) end")} frag from f0),
  c as (select *, coalesce(sum(length(q)+1) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) s from t0 where not forced and q <> ''),
  j as (select conv_id, string_agg(q, ' ' order by i) whole from c group by all), p as (select conv_id, frag, case when frag <> '' then instr(whole, frag) - 1 else -1 end loc from f join j using (conv_id)),
  hit as (select c.conv_id, string_agg(i::varchar, ',' order by i) covered from c join p using (conv_id) where loc >= 0 and loc < s + length(q) and loc + length(frag) > s group by all)"""


@check("fragment_cards", _CARDS + " select f.conv_id, coalesce(covered, '') covered from f left join hit using (conv_id)")
def fragment_cards(spark, sf_dir):
    hit = E.locate_fragment(F.col("items"), F.col("fragment"))
    return _cards(spark, sf_dir).select("conv_id", F.array_join(F.transform(hit, lambda i: i.cast("string")), ",").alias("covered"))


_INJECTED = _CARDS.replace("with t0 as (select conv_id, turn,", "with t0 as (select conv_id, turn, text,") + r""",
  raw as (select conv_id, case when conv_id % 3 = 0 then 'nowhere at all' when conv_id % 3 = 1 and b is not null then right(a, 4) || ' ' || left(b, 4) else right(a, 4) end fragment from f0),
  it as (select conv_id, i, text, forced, regexp_extract(text, '(\S+)', 1) term from t0),
  cov as (select c.conv_id, i from c join p using (conv_id) where loc >= 0 and loc < s + length(q) and loc + length(frag) > s),
  old as (select conv_id, i, term, row_number() over (partition by conv_id, lower(term) order by i) rn, count(*) over (partition by conv_id) n from it join cov using (conv_id, i)),
  kept as (select conv_id, term, i from old where n = 1 or rn = 1),
  fresh as (select conv_id, unnest(['NEW', term]) term, unnest([1000001, 1000002]) i from it where i = 0),
  held as (select * from kept union all select * from fresh where conv_id in (select conv_id from cov) and not exists (select 1 from kept k where k.conv_id = fresh.conv_id and lower(k.term) = lower(fresh.term))),
  fused as (select conv_id, string_agg(text, ' ' order by i) quote, min(i) i from it join cov using (conv_id, i) group by conv_id),
  out as (select conv_id, i, text quote, forced, term terms from it where not exists (select 1 from cov where cov.conv_id = it.conv_id and cov.i = it.i)
    union all select f.conv_id, any_value(f.i), any_value(quote), false, string_agg(term, ',' order by case when instr(hay, t) > 0 then instr(hay, t) else 2147483647 end, h.i)
      from (select *, lower(NORMQ) hay from fused) f join (select *, lower(NORMT) t from held) h using (conv_id) group by f.conv_id
    union all select conv_id, 1000000000, fragment, true, 'NEW,' || term from raw join it using (conv_id) where it.i = 0 and conv_id not in (select conv_id from cov))
  select conv_id, (row_number() over (partition by conv_id order by i) - 1)::int slot, quote, forced, terms from out""".replace("NORMQ", K.norm("quote")).replace("NORMT", K.norm("term"))


@check("injected_concepts", _INJECTED)
def injected_concepts(spark, sf_dir):
    rows = E.inject_concepts(_cards(spark, sf_dir)).select("conv_id", F.posexplode("items").alias("slot", "c"))
    return rows.select("conv_id", "slot", "c.quote", "c.forced", F.array_join(F.transform("c.concepts", lambda x: x["term"]), ",").alias("terms"))


@check("distinct_concepts", "select event_id, case when lower(event_type) = 'click' then '' else 'click' end || case when lower(event_type) = 'view' then '' else ',View' end fresh from events where event_type not in ('x') and lower(event_type) <> 'click' union all select event_id, 'View' from events where lower(event_type) = 'click'")
def distinct_concepts(spark, sf_dir):
    c = lambda t: F.struct(t.alias("term"), F.lit("").alias("explanation"))
    fresh = E.concepts_distinct(F.array(c(F.upper("event_type"))), F.array(c(F.lit("click")), c(F.lit("View"))))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(fresh, lambda x: x["term"]), ",").alias("fresh"))


@check("cached_and_open_requests", """select conv_id, turn, text in (select text from conversations where turn = 0) cached from conversations""")
def cached_and_open_requests(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", E.explain_cache_key(F.lit("f"), F.col("text"), F.lit("en")).alias("key"))
    cache = t.where("turn = 0").select("key", "text").distinct()
    hit, todo = E.cache_lookup(t, cache, ("text",))
    return hit.select("conv_id", "turn", F.lit(True).alias("cached")).unionByName(todo.select("conv_id", "turn", F.lit(False).alias("cached")))


def echo_client():
    """A stand-in for a model: explains every sentence it is shown. Every seventh length of a prompt fails at the first try, whatever was asked before."""
    import hashlib
    import json
    import re

    failed = set()

    def ask(prompt):
        if len(prompt) % 7 == 0 and prompt not in failed:
            failed.add(prompt)
            return 503, None, None
        failed.discard(prompt)
        if "[S0]" not in prompt:
            return 200, json.dumps({"acronyms": [], "core_methodology": f"{len(prompt)} {hashlib.md5(prompt.encode()).hexdigest()}", "assumed_concepts": []}), "STOP"
        found = re.findall(r"^\[S(\d+)\] (.*)$", prompt, re.M)
        cards = [{"sentence_indices": [int(i)], "quote": s, "concepts": [{"term": s.split()[0], "explanation": "e"}]} for i, s in found]
        return 200, json.dumps({"sentence_explanations": cards, "paragraph_context": {"section_role": "r", "narrative": "n"}}), "STOP"

    return ask


@check("scored_requests", """select conv_id, turn, 200 status, 'STOP' finish, case when length('[S0] ' || text) % 7 = 0 then 2 else 1 end attempts from conversations where text is not null""")
def scored_requests(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("[S0] "), "text").alias("prompt"))
    return E.score_requests(t, echo_client, wait=False).select("conv_id", "turn", "status", "finish", "attempts")


# -- edits -----------------------------------------------------------------------------------------------


def sample_overrides(pages):
    """Overrides by key on some pages, overrides that carry a box on others."""
    c, none = F.col, F.lit(None)
    by_key = pages.where(((c("doc_id") + c("page")) % 6 == 0) & c("ri").isin(1, 2, 3)).select(
        "doc_id", F.when(c("kind") == "image", D.image_key()).otherwise(D.block_key()).alias("key"), c("ri").alias("n"), none.cast("int").alias("page"),
        *[none.cast("double").alias(b) for b in BOX], F.when(c("ri") == 1, "ignored").alias("role"),
        F.when(c("ri") == 2, False).alias("continuation"), F.when(c("ri") == 3, False).alias("allow_merges"))
    boxed = pages.where(((c("doc_id") + c("page")) % 6 == 1) & (c("ri") == 0)).select(
        "doc_id", D.paint_key().alias("key"), c("page").alias("n"), "page", *BOX, F.lit("footnote").alias("role"),
        none.cast("boolean").alias("continuation"), none.cast("boolean").alias("allow_merges"))
    return by_key.unionByName(boxed)


_OV = """
ovk as (select doc_id, page, ri, kind, x0, y0, x1, y1, ri n, case when ri = 1 then 'ignored' end nrole, ri = 2 nocont, ri = 3 pin from pflow where (doc_id+page) % 6 = 0 and ri in (1,2,3)),
ovb as (select doc_id, page, page n, x0, y0, x1, y1, 'footnote' nrole from pflow where (doc_id+page) % 6 = 1 and ri = 0)"""
from checks.flow_checks import PAGE_FLOW  # noqa: E402


@check("overrides_on_pages", K.sql("""select p.doc_id, p.page, p.ri, coalesce(o.nrole, p."role") "role", p.continuation and not (p.kind = 'block' and coalesce(o.nocont, false)) continuation, not coalesce(o.pin, false) allow_merges
   from pflow p left join ovk o using (doc_id, page, ri)""", PLAIN, PAGE_FLOW, _OV))
def overrides_on_pages(spark, sf_dir):
    p = flowed_pages(spark, sf_dir)
    return D.apply_overrides_pages(p, sample_overrides(p)).select("doc_id", "page", "ri", "role", "continuation", "allow_merges")


_PLACED = "ovp as (select doc_id, page, n, x0, y0, x1, y1, nrole, nocont, pin from ovk where kind = 'block' union all select doc_id, page, n, x0, y0, x1, y1, nrole, false, false from ovb)"


@check("overrides_on_linear", K.sql(f"""select l.doc_id, l.ri, coalesce(m.nrole, l."role") "role", l.continuation and not coalesce(m.nocont, false) continuation, not coalesce(m.pin, false) allow_merges
   from lflow l left join (select doc_id, ri, b.r nrole, b.c nocont, b.p pin from (select l.doc_id, l.ri, min_by({{'r': o.nrole, 'c': o.nocont, 'p': o.pin}}, o.n) b from lflow l join ovp o on o.doc_id = l.doc_id and o.page = l.page
   and {K.overlap('o.', 'l.')} >= 0.6 group by l.doc_id, l.ri)) m using (doc_id, ri)""", PLAIN, PAGE_FLOW, *_SENTS, LINEAR_FLOW, _OV, _PLACED))
def overrides_on_linear(spark, sf_dir):
    p, rows = flowed_pages(spark, sf_dir), linear_flow(spark, sf_dir)
    return D.apply_overrides_linear(rows, sample_overrides(p), p).select("doc_id", "ri", "role", "continuation", "allow_merges")


@check("overrides_on_metadata", K.sql(f"""select l.doc_id, l.ri, coalesce(max(o.nrole), 'ignored') "role" from pl l left join ovb o on o.doc_id = l.doc_id and o.page = l.page and {K.overlap('o.', 'l.')} >= 0.6 group by l.doc_id, l.ri""", PLAIN, PAGE_FLOW, _OV))
def overrides_on_metadata(spark, sf_dir):
    p = flowed_pages(spark, sf_dir)
    return D.apply_overrides_metadata(plain_linear(spark, sf_dir).drop("role"), sample_overrides(p)).select("doc_id", "ri", "role")


@check("injected_blocks", K.sql(f"""select l.doc_id, l.page, 'L:' || l.page || ':' || floor(l.x0 + 0.5)::bigint || ':' || floor(l.y0 + 0.5)::bigint linear_key, l.text from pl l
   join (select doc_id, page, seq, count(distinct k) n from sbox group by all) s using (doc_id, page, seq) where l."role" = 'paragraph' and not exists (
   select 1 from pp p where p.doc_id = l.doc_id and p.page = l.page and p.kind = 'image' and {K.overlap('l.', 'p.')} >= 0.6)""", PLAIN, *_SENTS))
def injected_blocks(spark, sf_dir):
    """Page rows keep the images only; every paragraph is missing, and those off the images are injected from the linear rows."""
    p = plain_pages(spark, sf_dir).where("kind = 'image'")
    rows = plain_linear(spark, sf_dir).withColumn("allow_merges", F.lit(True))
    pages = rows.select("doc_id", "page").distinct()
    out = D.inject_linear_only(p, rows, rows.where("1 = 0"), pages)
    return out.where("injected").select("doc_id", "page", "linear_key", "text")


@check("override_keys", K.sql("""select doc_id, page, ri, case when ri % 3 = 0 then 'L:' || page || ':' || floor(x0 + 0.5)::bigint || ':' || floor(y0 + 0.5)::bigint when kind = 'image' then 'img:' || page || ':' || ri else page || ':' || ri end as "key" from pp""", PLAIN))
def override_keys(spark, sf_dir):
    p = plain_pages(spark, sf_dir).withColumn("linear_key", F.when(F.col("ri") % 3 == 0, D.paint_key()))
    return p.select("doc_id", "page", "ri", D.override_key().alias("key"))


@check("latest_edits", """select user_id, event_type, arg_max(value, ts) value from events group by all""")
def latest_edits(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumnRenamed("ts", "edited_at").withColumn("edit_id", F.col("event_id"))
    return D.latest_edit(log, ["user_id", "event_type"], ["value"])


@check("saved_edits", "select user_id doc_id, arg_max(props, ts) payload from events group by all")
def saved_edits(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("edited_at"), F.col("event_id").alias("edit_id"), F.col("props").alias("payload"))
    return catalog.current_edits(log)


@check("merge_group_members", K.sql("""select doc_id, 'g' || page group_id, case when bool_or(kind = 'image') then 'figure' else 'paragraph' end result_role, count(*)::int members, min(page) page, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1,
   case when bool_or(kind = 'image') then string_agg(case when kind = 'image' then '' else text end, chr(10) order by ri) filter (kind <> 'image' and text <> '') else string_agg(text, chr(10) || chr(10) order by ri) filter (text <> '') end text
   from pp group by doc_id, page""", PLAIN))
def merge_group_members(spark, sf_dir):
    p = plain_pages(spark, sf_dir).withColumn("linear_key", F.lit(None).cast("string"))
    g = p.select("doc_id", F.concat(F.lit("g"), F.col("page").cast("string")).alias("group_id"), F.col("ri").alias("member_no"), "kind", "page", "ri", "linear_key")
    visual = g.groupBy("doc_id", "group_id").agg(F.when(F.max(F.col("kind") == "image"), "figure").otherwise("paragraph").alias("result_role"))
    out = D.merge_group_members(g.join(visual, ["doc_id", "group_id"]), p)
    return out.withColumn("text", F.when(F.col("text") != "", F.col("text"))).drop("footnotes")


@check("merged_roles", """select user_id, case when bool_or(event_type = 'error') then 'table' when bool_or(event_type = 'click') then 'figure' when bool_or(event_type = 'view') then 'algorithm' else 'paragraph' end merged from events group by user_id, event_id % 40""")
def merged_roles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "error", "table").when(F.col("event_type") == "click", "figure").when(F.col("event_type") == "view", "algorithm").otherwise("paragraph")
    g = e.groupBy("user_id", (F.col("event_id") % 40).alias("g")).agg(F.collect_set(role).alias("roles"))
    return g.select("user_id", T.resolve_merged_role("roles").alias("merged"))


_MEM = "struct(\"key\" varchar, kind varchar, page int)"
_GRP = f"struct(id varchar, members {_MEM}[], edited bigint, kind varchar)"
_LOG = f"""me as (select doc_id, unnest([((page // 3) * 64 + (ri + page) // 2)::bigint, ((page // 3) * 64 + 32 + ri % 32)::bigint]) edit_id, {{'key': 'block:' || page || ':' || ri, 'kind': kind, 'page': page}}::{_MEM} mem from pp),
ml as (select doc_id, edit_id, case when edit_id % 4 = 3 then list(mem order by mem."key")[1:1] else list(mem order by mem."key") end ms, row_number() over (partition by doc_id order by edit_id) k from me group by doc_id, edit_id),
mr as (
  select distinct doc_id, 0::bigint k, []::{_GRP}[] acc from ml
  union all
  select doc_id, k, case when edit_id % 4 <> 3 then case when len(ms) < 2 or len(members) < 2 then acc else list_concat(list_filter(rest, lambda g: g.id <> gid), [{{'id': gid, 'members': members, 'edited': edit_id, 'kind': case when list_contains(list_transform(members, lambda m: m.kind), 'image') then 'figure' else 'paragraph' end}}::{_GRP}]) end
      when len(touched) = 0 then acc when len(remaining) >= 2 then list_concat(others, [{{'id': touched[1].id, 'members': remaining, 'edited': edit_id, 'kind': touched[1].kind}}::{_GRP}]) else others end
  from (select *, coalesce(touched[1].id, 'mg-' || ms[1].page || '-' || array_to_string(list_transform(members, lambda m: regexp_replace(m."key", '[^A-Za-z0-9_]', '', 'g')), '-')) gid,
      list_filter(touched[1].members, lambda m: not list_contains(picked, m."key")) remaining, list_filter(acc, lambda g: g.id <> touched[1].id) others
    from (select *, list_filter(pool, lambda m, i: list_position(list_transform(pool, lambda x: x."key"), m."key") = i) members
      from (select *, list_concat(flatten(list_transform(touched, lambda g: g.members)), ms) pool
        from (select *, list_filter(acc, lambda g: list_has_any(list_transform(g.members, lambda m: m."key"), picked)) touched,
            list_filter(acc, lambda g: not list_has_any(list_transform(g.members, lambda m: m."key"), picked)) rest
          from (select mr.doc_id, l.k, l.edit_id, l.ms, list_transform(l.ms, lambda m: m."key") picked, mr.acc from mr join ml l on l.doc_id = mr.doc_id and l.k = mr.k + 1)))))),
mz as (select doc_id, unnest(acc) g, generate_subscripts(acc, 1) - 1 n from mr join (select doc_id, max(k) k from ml group by all) using (doc_id, k))"""


@check("replayed_merge_groups", _recursive(K.sql("""select doc_id, n::int n, g.id group_id, len(g.members)::int members, g.kind result_role from mz""", PLAIN, _LOG)))
def replayed_merge_groups(spark, sf_dir):
    """Every block is in two edits: with the neighbours of its place on three pages, and with its like on these pages. Every fourth edit cuts."""
    p = plain_pages(spark, sf_dir)
    member = F.struct(F.concat(F.lit("block:"), D.block_key()).alias("key"), F.col("kind").alias("kind"), F.col("page").alias("page"), F.lit(None).cast("string").alias("role"))
    first = F.floor(F.col("page") / 3) * 64
    edits = F.explode(F.array(first + F.floor((F.col("ri") + F.col("page")) / 2), first + 32 + F.col("ri") % 32))
    log = p.select("doc_id", edits.alias("edit_id"), member.alias("m")).groupBy("doc_id", "edit_id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    log = log.withColumn("op", F.when(F.col("edit_id") % 4 == 3, "cut").otherwise("merge")).withColumn("members", F.when(F.col("op") == "cut", F.slice("members", 1, 1)).otherwise(F.col("members")))
    return D.replay_merge_groups(log).select("doc_id", "n", "group_id", F.size("members").alias("members"), "result_role")


# -- jobs and the store ----------------------------------------------------------------------------------

_PHASES = "['queued','started','device_started','batch_attempt','batch_oom','chunk_progress','done','failed']"


def progress_events(spark, sf_dir):
    e = F.col("event_id")
    phases = F.array(*[F.lit(p) for p in ("queued", "started", "device_started", "batch_attempt", "batch_oom", "chunk_progress", "done", "failed")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "ts", F.get(phases, (e % 8).cast("int")).alias("phase"), F.col("props").alias("message"),
        (e % 2).cast("int").alias("tier_index"), (e % 5).cast("int").alias("chunk_index"), (e % 4).cast("int").alias("total_chunks"))


_PE = f"pe as (select user_id job_id, event_id, ts, ({_PHASES})[event_id % 8 + 1] phase, props message, (event_id % 2)::int tier_index, (event_id % 5)::int chunk_index, (event_id % 4)::int total_chunks from events)"


@check("job_states", f"""with {_PE}, ends as (select job_id, min(ts) e from pe where phase in ('done','failed') group by all)
   select job_id, phase, case when phase in ('queued','done','failed') then phase else 'running' end status, case when phase = 'failed' then message end error, created_at, e finished_at from (
   select pe.job_id, e, arg_max(phase, ts) filter (e is null or ts <= e) phase, arg_max(message, ts) filter (e is null or ts <= e) message, min(ts) created_at from pe left join ends using (job_id) group by all)""")
def job_states(spark, sf_dir):
    return J.job_status(progress_events(spark, sf_dir))


@check("events_until_terminal", f"with {_PE} select job_id, event_id, phase from (select *, min(ts) filter (phase in ('done','failed')) over (partition by job_id) e from pe) where e is null or ts <= e")
def events_until_terminal(spark, sf_dir):
    return J.until_terminal(progress_events(spark, sf_dir)).select("job_id", "event_id", "phase")


@check("progress_percent", f"""with {_PE} select event_id, (case phase when 'started' then 5 when 'device_started' then 10 when 'batch_attempt' then case when tier_index = 0 then 15 else 0 end when 'batch_oom' then 0
   when 'chunk_progress' then least(90, 25 + floor(60.0*(chunk_index+1)/greatest(1, total_chunks) + 0.5)) when 'done' then 100 when 'failed' then 0 end)::int percent,
   case phase when 'batch_attempt' then case when tier_index = 0 then 'analyzing' else 'fallback' end when 'batch_oom' then 'fallback' when 'done' then 'done' when 'failed' then 'error' when 'queued' then null else 'analyzing' end status from pe""")
def progress_percent(spark, sf_dir):
    return J.progress_view(progress_events(spark, sf_dir)).select("event_id", "percent", "status")


def attempts(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (e % n).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("profile"), "ts", pick((0, 137, 138, 3, -9, 2), 6).alias("rc"),
        pick(("", "MemoryError", "CUDAOutOfMemoryError", "ValueError", None, "Timeout", "AcceleratorError"), 7).alias("error_type"),
        pick(("", "cudaErrorUnknown", "x"), 11).alias("message"), pick(("cuda", "cpu"), 2).alias("device"), (1 + e % 6).cast("int").alias("batch"),
        (e % 3 * 4).cast("int").alias("chunk_size"), F.col("value").alias("pdf_mb"))


_AT = """at0 as (select *, ([0,137,138,3,-9,2])[event_id % 6 + 1] rc, (['','MemoryError','CUDAOutOfMemoryError','ValueError',null,'Timeout','AcceleratorError'])[event_id % 7 + 1] err,
  coalesce((['','cudaErrorUnknown','x'])[event_id % 11 + 1], '') msg, (['cuda','cpu'])[event_id % 2 + 1] device, (1 + event_id % 6)::int batch, (event_id % 3 * 4)::int chunk_size from events),
at1 as (select *, case when rc = 0 and coalesce(err, '') = '' then 'ok' when (err is not null and (err in ('CUDAOutOfMemoryError','AcceleratorError') or msg like '%cudaErrorUnknown%')) or rc = 138 then 'cuda_oom'
  when (err in ('MemoryError','CUDAOutOfMemoryError','Timeout','HardKill')) or (err is null and rc <> 0) then 'oom' else 'error' end outcome from at0)"""


@check("attempt_outcomes", f"with {_AT} select event_id attempt_id, outcome from at1")
def attempt_outcomes(spark, sf_dir):
    return attempts(spark, sf_dir).select("attempt_id", J.classify_attempt().alias("outcome"))


@check("attempt_stats", f"""with {_AT} select device, batch, chunk_size, count(*) attempts, count(*) filter (outcome = 'ok') ok, count(*) filter (outcome = 'oom') oom, count(*) filter (outcome = 'cuda_oom') cuda_oom,
   count(*) filter (outcome = 'error') errors, round(avg(value), 2) avg_mb from at1 group by all""")
def attempt_stats(spark, sf_dir):
    return J.attempt_stats(attempts(spark, sf_dir))


@check("trailing_history", "select event_id attempt_id, user_id profile from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 100")
def trailing_history(spark, sf_dir):
    return J.trailing_history(attempts(spark, sf_dir)).select("attempt_id", "profile")


_CHUNK = """ck as (select *, (page - 1) // 2 chunk, ((page - 1) % 2) + 1 cpage, ri - min(ri) over (partition by doc_id, (page - 1) // 2) cri from pl)"""


def _chunked(spark, sf_dir):
    from pyspark.sql import Window

    rows = plain_linear(spark, sf_dir).withColumn("chunk", F.floor((F.col("page") - 1) / 2).cast("int"))
    first = F.min("ri").over(Window.partitionBy("doc_id", "chunk"))
    cut = settle(rows.withColumns({"ri": F.col("ri") - first, "page": ((F.col("page") - 1) % 2 + 1).cast("int")}).drop("span"))
    chunks = cut.select("doc_id", "chunk").distinct().withColumn("page_offset", F.col("chunk") * 2)
    return cut, chunks


@check("concatenated_chunks", K.sql("select doc_id, page, ri, text from pl", PLAIN))
def concatenated_chunks(spark, sf_dir):
    """Chunks of two pages, numbered anew in each, come back in the numbering of the whole document."""
    return J.concat_chunks(*_chunked(spark, sf_dir)).select("doc_id", "page", "ri", "text")


@check("stitched_chunks", K.sql("select doc_id, page, ri, continuation from lflow", PLAIN, *_SENTS, LINEAR_FLOW))
def stitched_chunks(spark, sf_dir):
    return J.stitch_chunks(*_chunked(spark, sf_dir)).select("doc_id", "page", "ri", "continuation")


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".pdf")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext).alias("filename"), F.col("n_chars").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))


def _analyses(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))


@check("document_catalog", """select 'doc' || doc_id || '.pdf' filename, n_chars size_bytes, doc_id in (select doc_id from labels) has_analysis, make_timestamp(doc_id * 1000000) modified from documents where doc_id % 9 <> 0""")
def document_catalog(spark, sf_dir):
    return catalog.document_catalog(_files(spark, sf_dir), _analyses(spark, sf_dir))


@check("admitted_documents", """select 'doc' || doc_id || '.pdf' filename, case when doc_id % 7 = 0 then 'rejected' when doc_id in (select doc_id from labels) then 'conflict' else 'admitted' end verdict,
   case when doc_id % 7 = 0 then 'rejected' else 'admitted' end verdict_overwrite from documents""")
def admitted_documents(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
                                                   F.when(F.col("doc_id") % 7 == 0, "text/html").otherwise("application/pdf").alias("content_type"))
    known = _analyses(spark, sf_dir)
    a = catalog.admit_documents(new, known).select("filename", "verdict")
    b = catalog.admit_documents(new, known, overwrite=True).select("filename", F.col("verdict").alias("verdict_overwrite"))
    return a.join(b, "filename")


@check("deleted_documents", """select 'document' kind, 'doc' || doc_id || case when doc_id % 9 = 0 then '.txt' else '.pdf' end filename from documents where not (doc_id % 4 = 0 and doc_id % 9 <> 0)
   union all select 'analysis', 'doc' || doc_id || '.pdf' from labels where doc_id not in (select doc_id from documents where doc_id % 4 = 0)""")
def deleted_documents(spark, sf_dir):
    names = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    docs, analyses = catalog.delete_documents(_files(spark, sf_dir), _analyses(spark, sf_dir), names)
    return docs.select(F.lit("document").alias("kind"), "filename").unionByName(analyses.select(F.lit("analysis").alias("kind"), "filename"))


# -- whole plans -----------------------------------------------------------------------------------------


@check("both_projections", WS.BOTH)
def both_projections(spark, sf_dir):
    """Page rows, linear rows and left-out text of every document after all merges."""
    x = X.extract_both(bronze(spark, sf_dir))
    cols = ["doc_id", "page", "role", "text", *BOX]
    return (
        x.page_rows.select(F.lit("page").alias("table"), "ri", *cols, "continuation", "caption_text")
        .unionByName(x.linear.select(F.lit("linear").alias("table"), "ri", *cols, "continuation", "caption_text"))
        .unionByName(x.metadata.select(F.lit("metadata").alias("table"), F.col("seq").alias("ri"), F.col("source_type").alias("role"), "doc_id", "page", "text", *BOX), allowMissingColumns=True))


def _info(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("lang").alias("language"))


_FULL = WS._named(GLUED, pflow="pages_done")
_ANALYZED = WS.whole("""select doc_id, filename, page_count, coalesce(n, 0)::int linear_blocks, length(prompt) || ' ' || md5(prompt) core_methodology, lang "language"
   from (select d.doc_id, 'doc' || d.doc_id || '.pdf' filename, d.lang, t.full_text || chr(10) || chr(10) || 'Language of all values but verbatim quotes: ' || case coalesce(d.lang, 'es') when 'es' then 'Spanish' else 'English' end || '.' prompt
     from documents d join (select doc_id, string_agg(text, chr(10) || chr(10) order by gid) full_text from glued group by all) t using (doc_id))
   join (select doc_id, count(*)::int page_count from lay left join (select doc_id, min(p_stop // 100000) stop from w group by all) using (doc_id) where stop is null or page <= stop group by all) using (doc_id)
   left join (select doc_id, count(*) n from linear_done group by all) using (doc_id)""", _FULL)


@check("analyzed_documents", _ANALYZED)
def analyzed_documents(spark, sf_dir):
    a = PA.analyze(bronze(spark, sf_dir), _info(spark, sf_dir), echo_client, wait=False)
    return a.select("doc_id", "filename", "page_count", F.size("linear_blocks").alias("linear_blocks"), "global_map.core_methodology", "language")


# The stand-in explains every sentence in its own words, so each has its card.
_CARD_ROWS = K.sql("""select doc_id, chain, m::int slot, m::int item, text quote, false is_placeholder from mt""", PLAIN, *_SENTS, LINEAR_FLOW, CHAINS.replace(_PIN, "false"), MERGED, ANSWERS)


@check("explained_chains", _CARD_ROWS)
def explained_chains(spark, sf_dir):
    rows = whole_rows(spark, sf_dir, linear_flow(spark, sf_dir))
    info = _info(spark, sf_dir).withColumn("map_json", F.lit("{}"))
    cache = spark.createDataFrame([], "key string, body string, finish string")
    cards = PE.explain(rows, info, cache, echo_client, wait=False)
    return cards.select("doc_id", "chain", "slot", "item", "quote", "is_placeholder")


_BOX_TEXT = " || ',' || ".join(f"regexp_replace({b}::varchar, '\\.0$', '')" for b in BOX)
_VISUAL = _caption_rows("pl", False)
_NUMBERED = f"""select v.*, d.lang, 'explain:v3:' || coalesce(d.lang, 'es') || ':doc' || v.doc_id || '.pdf:' head, v."role" || ':' || v.page || ':' || {_BOX_TEXT} tag from ({_VISUAL}) v join documents d using (doc_id) where v."role" in ('figure','table')"""


@check("visual_requests", _recursive(K.sql(f"""select doc_id, page, "role", x0, y0, x1, y1, caption_text caption, head || case when ltrim(b, '0') = '' then '0' else ltrim(b, '0') end as "key",
   'Map:' || chr(10) || '{{}}' || chr(10) || chr(10) || 'Kind:' || chr(10) || "role" || chr(10) || chr(10) || 'Caption:' || chr(10) || case when {K.strip('caption_text')} <> '' then {K.strip('caption_text')} else '(none)' end
     || chr(10) || chr(10) || 'Language of all values but verbatim quotes: ' || case coalesce(lang, 'es') when 'es' then 'Spanish' else 'English' end || '.' prompt
   from (select *, {_B36} b from (select *, {_text_hash('tag')} h from ({_NUMBERED})))""", PLAIN, *_caption_fold(False))))
def visual_requests(spark, sf_dir):
    """Requests for all figures and tables, with the captions they have taken."""
    rows = M.merge_figure_captions_linear(plain_linear(spark, sf_dir))
    return PE.visual_requests(rows, _info(spark, sf_dir).withColumn("map_json", F.lit("{}")))


def closed_client():
    """A model that must not be asked."""
    def ask(prompt):
        raise RuntimeError("asked again")
    return ask


@check("cached_answers", _CARD_ROWS)
def cached_answers(spark, sf_dir):
    """Cards of a second run: every answer comes from the store that the first run filled."""
    rows, info = whole_rows(spark, sf_dir, linear_flow(spark, sf_dir)), _info(spark, sf_dir).withColumn("map_json", F.lit("{}"))
    store = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    # Requests are prepared once; the first run fills the store and nobody reads its cards.
    asked = PE.prepare(rows, info)
    PE.explain_prepared(asked, store, echo_client, wait=False)
    cards = PE.explain_prepared(asked, store, closed_client, wait=False)
    return cards.select("doc_id", "chain", "slot", "item", "quote", "is_placeholder")


@check("reader_views", WS.VIEWS)
def reader_views(spark, sf_dir):
    """All eight tables of the view, one row per row of each."""
    x = X.extract_both(bronze(spark, sf_dir))
    log = sample_overrides(x.page_rows).withColumn("edit_id", F.col("n")).withColumn("edited_at", F.col("n"))
    v = PR.reader_view(x, log)
    words = lambda *cols: F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols])
    listed = F.array_join(F.transform("members", lambda i: i.cast("string")), ",")

    def rows(name, place, what, more=None, page=None, text=None, box=False):
        none = lambda kind: F.lit(None).cast(kind)
        return v[name].select(
            F.lit(name).alias("view"), "doc_id", (F.col(page) if page else none("int")).alias("page"), F.col(place).alias("place"), what.cast("string").alias("what"),
            (F.col(text) if text else none("string")).alias("text"), *[(F.col(b) if box else none("double")).alias(b) for b in BOX], (more if more is not None else none("string")).alias("more"))

    parts = [
        rows("page_rows", "ri", words("kind", "role"), words("continuation", "allow_merges", "injected"), "page", "text", True),
        rows("linear", "ri", F.col("role"), words("continuation", "chain"), "page", "text", True),
        rows("payloads", "ri", F.col("chain"), words(F.size("members"), F.size("sentences"), F.size("merged")), "page", "text"),
        rows("list", "idx", F.col("kind"), listed, text="text"), rows("page_sequence", "ri", F.col("kind"), page="page", box=True),
        rows("linear_sequence", "idx", F.col("kind"), words("ri", "flat_block_ref")), rows("outline", "idx", F.col("depth"), text="text"),
        rows("display", "idx", F.col("role"), words("slot", "rank", "is_tail"), "page"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
