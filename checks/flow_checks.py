"""Merges, continuation, chains and views, run over all blocks in reading order."""

from pyspark.sql import functions as F

from checks import sqlkit as K
from checks.page_checks import CONTEXT, WALK
from checks.registry import blocks, bronze, check, documents, shared
from checks.text_checks import LINE_SPANS, SENT_BOXES, sentences_sql
from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import continuation as C
from folioframe.operators import explain as E
from folioframe.operators import merges as M
from folioframe.operators import metadata as D
from folioframe.operators import ordering as O
from folioframe.operators import scans
from folioframe.operators import views as VW
from folioframe.operators import walk as W
from folioframe.operators.sentences import build_sentences
from folioframe.plans import extract as X
from folioframe.session import settle

BOX = ["x0", "y0", "x1", "y1"]


def linear_rows_of(b):
    """Linear rows of every block but dropped types: no filters, first header of a document as title."""
    b = O.reading_order(scans.by_span(b)).where(~F.col("block_type").isin(V.DROP_TYPES))
    header, image = F.col("block_type") == "SectionHeader", F.col("block_type").isin(V.IMAGE_TYPES)
    b = scans.dense_index(b, ["page", "ord"], "ri")
    role = F.when(header, F.when(F.col("ri") == 0, "title").otherwise("section_header")).when(
        image, T.image_role("block_type")).otherwise(T.text_role("block_type"))
    talks = ~header & F.col("block_type").isin(V.TEXT_TYPES)
    return b.withColumn("role", role).select(
        "doc_id", "span", "page", "ri", "role", "text", *BOX,
        F.when(talks, build_sentences()).otherwise(W.empty(W.NO_SENTENCES)).alias("sentences"), W.empty(W.NO_NOTES).alias("footnotes"),
        F.lit(False).alias("continuation"), F.lit("").alias("caption_text"), F.lit(None).cast(W.NO_BOX).alias("caption_bbox"))


@shared
def plain_linear(spark, sf_dir):
    return settle(linear_rows_of(blocks(spark, sf_dir)))


def page_rows_of(b):
    """Page rows of every block but dropped types and headers."""
    b = O.reading_order(scans.by_span(b)).where(~F.col("block_type").isin("SectionHeader", *V.DROP_TYPES))
    image = F.col("block_type").isin(V.IMAGE_TYPES)
    return b.select(
        "doc_id", "span", "page", (F.row_number().over(O.page_window().orderBy("ord")) - 1).alias("ri"),
        F.when(image, "image").otherwise("block").alias("kind"),
        F.when(image, T.image_role("block_type")).otherwise(T.text_role("block_type")).alias("role"), "text", *BOX,
        F.when(image, W.empty(W.NO_SENTENCES)).otherwise(build_sentences()).alias("sentences"), W.empty(W.NO_NOTES).alias("footnotes"),
        F.lit(False).alias("continuation"), F.lit("").alias("caption_text"), F.lit(None).cast(W.NO_BOX).alias("caption_bbox"))


@shared
def plain_pages(spark, sf_dir):
    return settle(page_rows_of(blocks(spark, sf_dir)))


FAT = ["sentences", "footnotes", "caption_text", "caption_bbox"]


@shared
def flowed_pages(spark, sf_dir):
    """Page rows with their continuation, without sentences: what needs none of them neither makes nor carries any."""
    return settle(C.continuation_pages(scans.by_span(page_rows_of(blocks(spark, sf_dir)).drop(*FAT))))


PLAIN = f"""
pl0 as (select *, (row_number() over (partition by doc_id order by page, ord) - 1)::int ri from ordered where block_type not in {K.DROPS}),
pl as (select doc_id, page, seq, ri, case when block_type = 'SectionHeader' then case when ri = 0 then 'title' else 'section_header' end
   when block_type = 'Table' then 'table' when block_type = 'Figure' then 'figure' else {K.text_role('block_type')} end "role", text, x0, y0, x1, y1, n_lines,
   block_type in {K.TEXTS} talks, min(x0) over (partition by doc_id, page) lo, max(x1) over (partition by doc_id, page) hi from pl0),
pp as (select doc_id, page, seq, (row_number() over (partition by doc_id, page order by ord) - 1)::int ri, case when block_type in {K.IMAGES} then 'image' else 'block' end kind,
   case when block_type = 'Table' then 'table' when block_type = 'Figure' then 'figure' else {K.text_role('block_type')} end "role", text, x0, y0, x1, y1,
   min(x0) over (partition by doc_id, page) lo, max(x1) over (partition by doc_id, page) hi
   from ordered where block_type not in {K.DROPS} and block_type <> 'SectionHeader')"""


def _key(*more):
    return ["doc_id", "page", "ri", *more]


def _rows(df):
    return df.select(*_key("role", "text", *BOX, "caption_text"))


def _caption_flags(vis):
    return f"""{vis} vis, text <> '' and {K.subfigure('text')} sub, "role" = 'caption' or ("role" = 'paragraph' and {K.caption_like('text')}) cap,
      "role" = 'paragraph' and {K.source_line(K.lstrip('text'))} src"""


def _caption_fold(pages):
    """One row of a page or run after another: ``ce`` holds the rows, ``cf`` the open figure after each, ``cp`` what was taken."""
    if pages:
        rows = f"""ce as (select *, page g, row_number() over (partition by doc_id, page order by ri) k from (select *, {_caption_flags("kind = 'image'")} from pp))"""
    else:
        rows = f"""ce as (select *, row_number() over (partition by doc_id, g order by ri) k from (
          select *, sum((not (vis or sub or cap or src))::int) over (partition by doc_id order by page, ri) g from (select *, {_caption_flags("role in ('figure','table')")} from pl)) where vis or sub or cap or src)"""
    near = (lambda p, back: f"({p}.ri = ri - {back} and {p}.cap)") if pages else (lambda p, back: f"({p}.cap)" if back == 1 else "false")
    free = lambda p: f"not list_contains(list_transform(cl, lambda d: d.ri), {p}.ri)"
    gap_y, low = "(y0 - uy1)", "least(uy1-uy0, y1-y0)"
    gap_x, thin = "(x0 - ux1)", "least(ux1-ux0, x1-x0)"
    contiguous = f"""({K.hov('u', '')} >= {V.PANEL_H_OVERLAP} and {gap_y} >= -{V.PANEL_SLOP}*{low} and y1 > uy1 + {V.GEOM_TOL} and {gap_y} <= greatest({V.PANEL_GAP}, {V.PANEL_GAP_FRACTION}*{low}))"""
    beside = f"""({K.vov('u', '')} >= {V.PANEL_V_OVERLAP} and {gap_x} >= -{V.GEOM_TOL} and {gap_x} <= greatest({V.PANEL_GAP}, {V.PANEL_GAP_FRACTION}*{thin}))"""
    closed = """case when oi is null then done when ai is not null and (fi is null or oy0 - ay1 <= fy0 - oy1)
      then list_concat(done, list_concat(list_filter(held, lambda h: coalesce(h.ri <> fi, true)), [{'ri': ai, 'owner': oi, 'panel': false, 'n': len(held)}])) else list_concat(done, held) end"""
    picks = "struct(ri int, owner int, panel boolean, n bigint)[]"
    me = "{'ri': ri, 'cap': cap and not vis, 'y1': y1}"
    return rows, f"""cf as (
      select doc_id, g, 0::bigint k, null::int oi, null::int opage, null::double oy0, null::double oy1, null::double ux0, null::double uy0, null::double ux1, null::double uy1, false hc, false hs, false saw,
        null::int ai, null::double ay1, null::int fi, null::double fy0, null::int li, null::struct(ri int, cap boolean, y1 double) p1, null::struct(ri int, cap boolean, y1 double) p2, []::{picks} held, []::{picks} done
        from (select distinct doc_id, g from ce)
      union all
      select doc_id, g, k, case when act > 0 then oi when vis then ri end, case when act > 0 then opage when vis then page end, case when act > 0 then oy0 else y0 end, case when act > 0 then oy1 else y1 end,
        case when act = 4 then least(ux0, x0) when act > 0 then ux0 else x0 end, case when act = 4 then least(uy0, y0) when act > 0 then uy0 else y0 end,
        case when act = 4 then greatest(ux1, x1) when act > 0 then ux1 else x1 end, case when act = 4 then greatest(uy1, y1) when act > 0 then uy1 else y1 end,
        act > 0 and (hc or act = 2), act > 0 and (hs or act = 3), act > 0 and act <> 4 and (saw or act = 1),
        case when act > 0 then ai when vis then ab.ri end, case when act > 0 then ay1 when vis then ab.y1 end,
        case when act = 2 then ri when act > 0 then fi end, case when act = 2 then y0 when act > 0 then fy0 end, ri, {me}, p1,
        case when act > 0 then list_concat(held, [{{'ri': ri, 'owner': oi, 'panel': act = 4, 'n': len(held)}}]) else []::{picks} end, case when act > 0 then done else cl end
      from (select *, case when {near('p1', 1)} and {free('p1')} then p1 when {near('p1', 2)} and {free('p1')} then p1 when {near('p2', 2)} and {free('p2')} then p2 end ab
        from (select *, case when oi is null {'or ri <> li + 1' if pages else ''} then 0 when sub and not hc and not hs and {K.hov('u', '')} >= {V.PANEL_H_OVERLAP} then 1
            when cap and not hc then 2 when src and not hs then 3
            when vis and not hc and not hs and (saw or ai is null) and page = opage and ({contiguous} or {beside}) then 4 else 0 end act, {closed} cl
          from (select cf.* exclude (k), e.k, e.ri, e.page, e.x0, e.y0, e.x1, e.y1, e.vis, e.sub, e.cap, e.src from cf join ce e on e.doc_id = cf.doc_id and e.g = cf.g and e.k = cf.k + 1)))),
    cl as (select doc_id, g, {closed} picks from cf join (select doc_id, g, max(k) k from ce group by all) using (doc_id, g, k)),
    cp as (select doc_id, g, p.ri ri, p."owner" "owner", p.panel panel, p.n n from (select doc_id, g, unnest(picks) p from cl)),
    cm as (select doc_id, "owner", {'g,' if pages else ''} string_agg(text, chr(10) order by y0, n) filter (not panel) cap, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from cp join ce using (doc_id, g, ri) group by all)"""


def _caption_rows(source, pages):
    page = "and m.g = p.page" if pages else ""
    text = "case when p.kind = 'image' then '' else p.text end" if pages else "p.text"
    return f"""select p.doc_id, p.page, p.ri, p."role", {text} text, least(p.x0, m.x0) x0, least(p.y0, m.y0) y0, greatest(p.x1, m.x1) x1, greatest(p.y1, m.y1) y1, coalesce(m.cap, '') caption_text
      from {source} p left join cm m on m.doc_id = p.doc_id and m."owner" = p.ri {page}
      where not exists (select 1 from cp where cp.doc_id = p.doc_id and cp.ri = p.ri {'and cp.g = p.page' if pages else ''})"""


def _recursive(sql):
    return sql.replace("with ", "with recursive ", 1)


@check("captions_linear", _recursive(K.sql(_caption_rows("pl", False), PLAIN, *_caption_fold(False))))
def captions_linear(spark, sf_dir):
    return _rows(M.merge_figure_captions_linear(plain_linear(spark, sf_dir)))


@check("captions_pages", _recursive(K.sql(_caption_rows("pp", True), PLAIN, *_caption_fold(True))))
def captions_pages(spark, sf_dir):
    return _rows(M.merge_figure_captions_pages(plain_pages(spark, sf_dir)))


def _table_fold(source):
    """One anchor (label or table) of a page after another: ``tw`` holds what was taken after each."""
    note = lambda t, taken: f"""list_sort(list_transform(list_filter(later, lambda r: r.note and not list_contains(list_transform(acc, lambda a: a.ri), r.ri) and not list_contains({taken}, r.ri)
        and r.y0 - {t}.y1 between -{V.GEOM_TOL} and {V.TABLE_NOTE_GAP} and {K.hov(t + '.', 'r.')} >= {V.TABLE_OVERLAP}), lambda r: {{'gap': r.y0 - {t}.y1, 'ri': r.ri}}))[1].ri"""  # noqa: E731
    members = lambda ids, owner: f"list_transform({ids}, lambda i, k: {{'ri': i, 'owner': {owner}, 'n': k}})"
    cell = "struct(ri int, x0 double, y0 double, x1 double, y1 double, tab boolean, label boolean, note boolean, ttl boolean)"
    return f"""te as (select doc_id, page, ri, x0, y0, x1, y1, "role" = 'table' tab, {K.table_label('"role"', 'text')} label, {K.table_note('"role"', 'text')} note,
        "role" in ('paragraph','caption','section_header') and {K.n_words('text')} <= {V.TABLE_TITLE_WORDS} ttl from {source}),
    tg as (select doc_id, page, list({{'ri': ri, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'tab': tab, 'label': label, 'note': note, 'ttl': ttl}}::{cell} order by ri) arr from te group by all),
    ta as (select doc_id, page, arr, unnest(list_filter(arr, lambda r: r.label or r.tab)) b, generate_subscripts(list_filter(arr, lambda r: r.label or r.tab), 1) k from tg),
    tw as (
      select doc_id, page, 0::bigint k, []::struct(ri int, "owner" int, n bigint)[] acc from tg
      union all
      select doc_id, page, k, case when list_contains(list_transform(acc, lambda a: a.ri), b.ri) then acc
          when b.label then case when kind = 2 then list_concat(acc, {members('list_filter(list_append(ids, nl), lambda i: i is not null)', 'tb.ri')}) else acc end
          when ns is not null then list_concat(acc, {members('[b.ri, ns]', 'b.ri')}) else acc end
      from (select *, {note('tb', 'ids')} nl, {note('b', '[b.ri]')} ns
        from (select *, kinds[pos] kind, ahead[pos] tb, list_concat([b.ri], list_concat(list_transform(ahead[1 : coalesce(pos, 1) - 1], lambda r: r.ri), [ahead[pos].ri])) ids
          from (select *, list_position(list_transform(kinds, lambda x: x <> 1), true) pos
            from (select *, list_transform(ahead, lambda r: case when list_contains(list_transform(acc, lambda a: a.ri), r.ri) then 0
                when r.tab and r.y1 >= b.y0 and {K.hov('b.', 'r.')} >= {V.TABLE_OVERLAP} then 2 when not r.ttl then 0 else 1 end) kinds
              from (select *, later[1 : {V.TABLE_LOOKAHEAD}] ahead
                from (select tw.doc_id, tw.page, tw.acc, a.k, a.b, list_filter(a.arr, lambda r: r.ri > a.b.ri) later from tw join ta a on a.doc_id = tw.doc_id and a.page = tw.page and a.k = tw.k + 1)))))) ),
    tz as (select doc_id, page, unnest(acc, recursive := true) from tw join (select doc_id, page, max(k) k from tw group by all) using (doc_id, page, k)),
    tm as (select doc_id, page, "owner", min(ri) filter (n = 1) first_ri, string_agg(text, chr(10) order by n) filter (text <> '') whole, string_agg(text, chr(10) order by n) filter (text <> '' and ri <> "owner") others,
      min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from tz join {source} using (doc_id, page, ri) group by all)"""


@check("tables_linear", _recursive(K.sql("""select p.doc_id, p.page, coalesce(m.first_ri, p.ri) ri, p."role", case when m."owner" is null then p.text else coalesce(m.whole, '') end text,
    least(p.x0, m.x0) x0, least(p.y0, m.y0) y0, greatest(p.x1, m.x1) x1, greatest(p.y1, m.y1) y1, coalesce(m.others, '') caption_text
    from pl p left join tm m on m.doc_id = p.doc_id and m.page = p.page and m."owner" = p.ri
    where not exists (select 1 from tz where tz.doc_id = p.doc_id and tz.page = p.page and tz.ri = p.ri and tz.ri <> tz."owner")""", PLAIN, _table_fold("pl"))))
def tables_linear(spark, sf_dir):
    return _rows(M.merge_tables_linear(plain_linear(spark, sf_dir)))


_NOTES = f"""tn as (select t.doc_id, t.page, t.ri tri, n.ri nri, n.y0 - t.y1 gap, n.text, n.x0 bx0, n.y0 by0, n.x1 bx1, n.y1 by1 from pp t join pp n using (doc_id, page)
   where t.role = 'table' and n.kind = 'block' and {K.table_note('n."role"', 'n.text')} and n.y0 - t.y1 between -2.0 and 200.0 and {K.hov('t.', 'n.')} >= 0.15),
tl as (select doc_id, page, list([{{'ri': tri, 'c': cs}}] order by tri) ts from (select doc_id, page, tri, list({{'gap': gap, 'ri': nri}} order by gap, nri) cs from tn group by all) group by all),
tf as (select doc_id, page, list_reduce(list_transform(ts, lambda t: [{{'t': t[1].ri, 'c': t[1].c, 'n': null::int}}]), lambda acc, t: list_concat(acc,
   [{{'t': t[1].t, 'c': t[1].c, 'n': (list_filter(t[1].c, lambda c: not list_contains(list_transform(acc, lambda a: a.n), c.ri)))[1].ri}}]), []) fs from tl),
tp as (select doc_id, page, f.t tri, f.n nri from (select doc_id, page, unnest(fs) f from tf) where f.n is not null)"""


@check("table_notes_pages", K.sql("""select p.doc_id, p.page, p.ri, p.role, case when p.kind = 'image' then '' else p.text end text, least(p.x0, coalesce(bx0, p.x0)) x0, least(p.y0, coalesce(by0, p.y0)) y0,
   greatest(p.x1, coalesce(bx1, p.x1)) x1, greatest(p.y1, coalesce(by1, p.y1)) y1, coalesce(m.text, '') caption_text from pp p
   left join (select tp.*, tn.text, bx0, by0, bx1, by1 from tp join tn using (doc_id, page, tri, nri)) m on m.doc_id = p.doc_id and m.page = p.page and m.tri = p.ri
   where not exists (select 1 from tp where tp.doc_id = p.doc_id and tp.page = p.page and tp.nri = p.ri)""", PLAIN, _NOTES))
def table_notes_pages(spark, sf_dir):
    return _rows(M.merge_table_notes_pages(plain_pages(spark, sf_dir)))


def _algorithms(source, walls, pages):
    lone = "kind = 'block'" if pages else "true"
    return f"""al0 as (select *, {lone} consid, {lone} and {K.algorithm_header('text')} opener from {source}),
    al1 as (select *, opener and "role" in ('paragraph','code','caption') st from al0),
    al2 as (select *, sum(st::int) over (partition by doc_id, page, consid order by ri) region from al1),
    al3 as (select *, row_number() over o - 1 k, min(x0) over e ux0, min(y0) over e uy0, max(x1) over e ux1, max(y1) over e uy1,
      greatest(1.0, first_value(y1-y0) over o) hh, first_value({K.label_only('text')}) over o bare from al2
      window o as (partition by doc_id, page, consid, region order by ri), e as (partition by doc_id, page, consid, region order by ri rows between unbounded preceding and 1 preceding)),
    al4 as (select *, case when k = 0 then false when opener or "role" in {walls} then true when "role" = 'equation' then {K.hov('u', '')} < 0.55
      when k = 1 and bare and "role" in ('paragraph','caption','code') and text <> '' and {K.n_words('text')} <= 14 then y0 - uy1 > hh*3.0
      else y0 - uy1 > hh*1.8 or {K.hov('u', '')} < 0.55 end br from al3),
    al5 as (select *, consid and region > 0 and not bool_or(br) over (partition by doc_id, page, consid, region order by ri) mem from al4),
    al as (select * exclude (mem), mem and count(*) filter (mem) over (partition by doc_id, page, consid, region) > 1 mem from al5),
    am as (select doc_id, page, region, min(ri) ri, min(x0) mx0, min(y0) my0, max(x1) mx1, max(y1) my1, string_agg(text, chr(10) order by ri) filter (text <> '') mtext,
      list(text order by ri) ts, list("role" order by ri) rs from al where mem group by all),
    amc as (select *, case when {K.label_only(K.strip('ts[1]'))} and rs[2] in ('paragraph','caption','code') and {K.strip('ts[2]')} <> '' and {K.n_words('ts[2]')} <= 14
      and not {K.algorithm_header('ts[2]')} then {K.strip('ts[1]')} || case when right({K.strip('ts[1]')}, 1) in (':','.','-','—') then '' else ':' end || ' ' || {K.strip('ts[2]')} else {K.strip('ts[1]')} end cap from am)"""


def _algorithm_rows(pages):
    text = "''" if pages else "mtext"
    plain = "case when kind = 'image' then '' else text end" if pages else "text"
    return f"""select doc_id, page, ri, 'algorithm' "role", {text} text, mx0 x0, my0 y0, mx1 x1, my1 y1, cap caption_text from amc
      union all select doc_id, page, ri, "role", {plain}, x0, y0, x1, y1, '' from al where not mem"""


@check("algorithms_linear", K.sql(_algorithm_rows(False), PLAIN, _algorithms("pl", "('section_header','title','author','figure','table')", False)))
def algorithms_linear(spark, sf_dir):
    return _rows(M.merge_algorithms(plain_linear(spark, sf_dir), pages=False))


@check("algorithms_pages", K.sql(_algorithm_rows(True), PLAIN, _algorithms("pp", "('section_header','title','author')", True)))
def algorithms_pages(spark, sf_dir):
    return _rows(M.merge_algorithms(plain_pages(spark, sf_dir), pages=True))


_ST = K.strip("text")
AUTHORS = f"""
au0 as (select *, min(ri) filter ("role" = 'title') over d tri, arg_min(page, ri) filter ("role" = 'title') over d tp, arg_min(page, ri) over d fp from pl window d as (partition by doc_id)),
au1 as (select *, coalesce(tp, fp) tpage, "role" = 'section_header' and ({K.body_name(_ST)} or {K.skip_section(_ST)}) known from au0),
au2 as (select *, min(y0) filter (known or ("role" = 'paragraph' and {K.n_words('text')} > 30 and not {K.dense_names('text')})) over (partition by doc_id, page) floor from au1),
au3 as (select *, "role" = 'author' or (page = tpage and "role" in ('paragraph','section_header') and {_ST} <> '' and not known
   and case when floor is not null then (y0+y1)/2 < floor else {K.author_line(_ST)} or {K.soft(_ST)} end) cand from au2),
au4 as (select *, case when cand then 1 when coalesce(ri <= tri, false) then 0 else 2 end part from au3),
au as (select *, (row_number() over (partition by doc_id order by part, case when part = 1 then page end, case when part = 1 then y0 end, case when part = 1 then x0 end, ri) - 1)::int nri,
   bool_or(cand) over (partition by doc_id) any_cand from au4)"""


@check("authors_after_title", K.sql("""select doc_id, page, case when any_cand then nri else ri end ri, case when cand then 'author' else "role" end "role", text from au""", PLAIN, AUTHORS))
def authors_after_title(spark, sf_dir):
    return C.authors_after_title(plain_linear(spark, sf_dir)).select(*_key("role", "text"))


_PARA_LH = "plh as (select doc_id, page, seq, list_sort(list(y1-y0))[count(*)//2 + 1] plh from sbox where y1-y0 > 0 group by all)"


def _lexical():
    return f"({K.rx('ptext', K.NS)} and ({K.lower_start('ptext', 'text')} or {K.bullet('text')} or {K.unterminated('ptext')}))"


LINEAR_FLOW = f"""
lp as (select pl.*, coalesce(plh, 0.0) plh, {K.layout_type('pl.', 'lo', 'hi')} lt from pl left join plh using (doc_id, page, seq)),
lq as (select *, lag(text) over w ptext, lag(page) over w apage, lag(x0) over w ax0, lag(y0) over w ay0, lag(x1) over w ax1, lag(y1) over w ay1, lag(plh) over w aplh, lag(lo) over w alo,
   lag(hi) over w ahi, lag(lt) over w alt, lag(ri) over w ari from lp where "role" = 'paragraph' window w as (partition by doc_id order by ri)),
lcov as (select q.doc_id, q.ri, sum({K.gap_cover('q.a', 'q.', 'f.')}) cov from lq q join lp f on f.doc_id = q.doc_id and f.page = q.page and q.apage = q.page and f.ri > q.ari and f.ri < q.ri group by all),
lc as (select q.doc_id, q.ri, coalesce(ptext is not null and {_lexical()}
   and {K.geometry_ok('a', 'apage', '', 'page', 'greatest(aplh, plh)', 'coalesce(cov, 0.0)', 'alo', 'ahi', 'lo', 'hi')}
   and case when lt = 'right-column' then alt in ('left-column','right-column') else true end
   and not {K.table_note("'paragraph'", 'text')} and not {K.table_note("'paragraph'", 'ptext')}, false) cont from lq q left join lcov using (doc_id, ri)),
lflow as (select lp.*, coalesce(cont, false) continuation from lp left join lc using (doc_id, ri))"""
_SENTS = (sentences_sql("(select doc_id, page, seq, text from pl where talks)"), LINE_SPANS, SENT_BOXES, _PARA_LH)


@shared
def linear_flow(spark, sf_dir):
    """Linear rows with their continuation, without texts and sentences; ``whole_rows`` has these."""
    slim = plain_linear(spark, sf_dir).withColumn("lh", F.when(F.col("role") == "paragraph", C.sentence_line_height()).otherwise(0.0)).drop(*FAT)
    return settle(C.continuation_linear(C.with_layout_type(scans.by_span(slim))).drop("text"))


def whole_rows(spark, sf_dir, marks):
    """The linear rows with all their columns, as marked in ``marks``."""
    whole = plain_linear(spark, sf_dir)
    return whole.drop("continuation").join(marks.select(*M.ROW_KEY, *[c for c in marks.columns if c == "continuation" or c not in whole.columns]), M.ROW_KEY)


@check("continuation_linear", K.sql("select doc_id, page, ri, lt layout_type, continuation from lflow", PLAIN, *_SENTS, LINEAR_FLOW))
def continuation_linear(spark, sf_dir):
    return linear_flow(spark, sf_dir).select(*_key("layout_type", "continuation"))


PAGE_FLOW = f"""
pq as (select *, lag(text) over w ptext, lag(page) over w apage, lag(x0) over w ax0, lag(y0) over w ay0, lag(x1) over w ax1, lag(y1) over w ay1, lag(lo) over w alo, lag(hi) over w ahi,
   lag(ri) over w ari from pp where "role" = 'paragraph' window w as (partition by doc_id order by page, ri)),
pcov as (select q.doc_id, q.page, q.ri, sum({K.gap_cover('q.a', 'q.', 'f.')}) cov from pq q join pp f on f.doc_id = q.doc_id and f.page = q.page and q.apage = q.page
   and ((f.kind = 'block' and f.ri > q.ari and f.ri < q.ri) or f.kind = 'image') group by all),
pc as (select q.doc_id, q.page, q.ri, coalesce(ptext is not null and {_lexical()}
   and {K.geometry_ok('a', 'apage', '', 'page', 'greatest(greatest(0.0, ay1-ay0), y1-y0)', 'coalesce(cov, 0.0)', 'alo', 'ahi', 'lo', 'hi')}, false) cont
   from pq q left join pcov using (doc_id, page, ri)),
pflow as (select pp.*, coalesce(cont, false) continuation from pp left join pc using (doc_id, page, ri))"""


@check("continuation_pages", K.sql("select doc_id, page, ri, continuation from pflow", PLAIN, PAGE_FLOW))
def continuation_pages(spark, sf_dir):
    return flowed_pages(spark, sf_dir).select(*_key("continuation"))


def _bridge(source, parts):
    near = K.math_adjacent("a", "")
    return f"""br0 as (select *, lag("role") over w ar, lag(text) over w atext, lag(x0) over w ax0, lag(y0) over w ay0, lag(x1) over w ax1, lag(y1) over w ay1 from {source} window w as (partition by {parts} order by ri)),
    br1 as (select *, coalesce("role" = 'equation' and text <> '' and ar = 'paragraph' and {K.unterminated('atext')} and {near}, false) j from br0),
    br as (select *, j or coalesce(lag(j) over (partition by {parts} order by ri) and "role" = 'paragraph' and {near}, false) bridged from br1)"""


@check("display_math_linear", K.sql("select doc_id, page, ri, bridged continuation from br", PLAIN, _bridge("pl", "doc_id, page")))
def display_math_linear(spark, sf_dir):
    return C.bridge_display_math(plain_linear(spark, sf_dir)).select(*_key("continuation"))


@check("display_math_pages", K.sql("select doc_id, page, ri, bridged continuation from br", PLAIN, _bridge("pp", "doc_id, page, kind")))
def display_math_pages(spark, sf_dir):
    return C.bridge_display_math(plain_pages(spark, sf_dir), "kind").select(*_key("continuation"))


@check("clipped_overlaps", K.sql(f"""select p.doc_id, p.page, p.ri, case when ys is null then y1 else list_reduce(ys, lambda a, y: case when a > y + 2.0 then y else a end, y1) end y1 from pl p left join (
   select doc_id, page, target ri, list(y0 order by ri) ys from (select b.doc_id, b.page, b.ri, b.y0, max(a.ri) target, arg_max(a.y0, a.ri) ay0 from pl b join pl a on a.doc_id = b.doc_id and a.page = b.page and a.ri < b.ri
     and {K.xov('a.', 'b.')} >= 0.3 group by b.doc_id, b.page, b.ri, b.y0) where ay0 <= y0 group by doc_id, page, target) using (doc_id, page, ri)""", PLAIN))
def clipped_overlaps(spark, sf_dir):
    return C.clip_overlaps(plain_linear(spark, sf_dir).withColumn("shelf", F.lit(0))).select(*_key("y1"))


def _glue(a, b):
    return f"case when right({K.rstrip(a)}, 1) in ('-','—','¬') then left({K.rstrip(a)}, length({K.rstrip(a)}) - 1) || {K.lstrip(b)} else {K.rstrip(a)} || ' ' || {K.lstrip(b)} end"


GLUED = f"""gl as (select *, sum((not continuation)::int) over (partition by doc_id order by page, ri)::bigint gid from pflow where kind = 'block'),
glued as (select doc_id, gid, list_reduce(list(text order by page, ri), lambda a, b: {_glue('a', 'b')}) text from gl group by all)"""


@check("glued_paragraphs", K.sql("select doc_id, gid, text from glued", PLAIN, PAGE_FLOW, GLUED))
def glued_paragraphs(spark, sf_dir):
    return C.glued_paragraphs(flowed_pages(spark, sf_dir).where("kind = 'block'"))


@check("full_texts", K.sql("select doc_id, string_agg(text, chr(10) || chr(10) order by gid) full_text from glued group by all", PLAIN, PAGE_FLOW, GLUED))
def full_texts(spark, sf_dir):
    return C.full_text(flowed_pages(spark, sf_dir).where("kind = 'block'"))


_WALKED_PAGES = f"""pp as (select doc_id, page, seq, p_ri ri, p_kind kind, p_role "role", text, x0, y0, x1, y1, min(x0) over (partition by doc_id, page) lo, max(x1) over (partition by doc_id, page) hi
   from w where p_kind in ('block','image') and not above)"""


def clean_documents(bronze_tables):
    """Clean text of every document: walk, continuation, glue; no merges."""
    rows = settle(X.extract_pages(bronze_tables).drop(*FAT))
    return C.full_text(settle(C.continuation_pages(scans.by_span(rows)).where("kind = 'block'").select("doc_id", "span", "page", "ri", "text", "continuation")))


@check("clean_documents", K.sql("select doc_id, string_agg(text, chr(10) || chr(10) order by gid) full_text from glued group by all", CONTEXT, WALK, _WALKED_PAGES, PAGE_FLOW, GLUED))
def _clean_documents(spark, sf_dir):
    return clean_documents(bronze(spark, sf_dir))


# -- chains ----------------------------------------------------------------------------------------------

_PIN = "(doc_id + ri) % 23 = 0"
CHAINS = f"""
ch0 as (select *, {_PIN} pin, "role" = 'paragraph' para, "role" = 'equation' and continuation eq from lflow),
ch1 as (select *, coalesce(last_value(case when para then not pin end ignore nulls) over (partition by doc_id order by ri rows between unbounded preceding and 1 preceding), false) opn from ch0),
ch2 as (select *, sum((para and (pin or not continuation or not opn))::int) over (partition by doc_id order by ri) c from ch1),
ch as (select *, case when para or (eq and opn) then c::int end chain from ch2)"""


@shared
def chained(spark, sf_dir):
    rows = linear_flow(spark, sf_dir).withColumns({
        "injected": F.lit(False), "allow_merges": (F.col("doc_id") + F.col("ri")) % 23 != 0})
    return settle(C.chain_ids(rows.select("doc_id", "span", "page", "ri", "role", "continuation", "injected", "allow_merges")))


def chained_rows(spark, sf_dir):
    return whole_rows(spark, sf_dir, chained(spark, sf_dir))


@check("chain_ids", K.sql("select doc_id, page, ri, chain from ch", PLAIN, *_SENTS, LINEAR_FLOW, CHAINS))
def chain_ids(spark, sf_dir):
    return chained(spark, sf_dir).select(*_key("chain"))


PAYLOAD = f"""
ns as (select doc_id, page, seq, count(distinct k) n from sbox group by all),
pay as (select doc_id, chain, list_reduce(list(text order by ri), lambda a, b: {_glue('a', 'b')}) text, arg_min(page, ri) page, min(ri) ri, count(*) members, sum(coalesce(n, 0)) sentences,
   string_agg(off::varchar, ',' order by ri) offsets from (select ch.*, n, coalesce(sum(coalesce(n, 0)) over (partition by doc_id, chain order by ri rows between unbounded preceding and 1 preceding), 0) off
   from ch left join ns using (doc_id, page, seq) where chain is not null) group by doc_id, chain)"""


@check("chain_payloads", K.sql("select doc_id, chain, page, ri, text, members::int members, sentences::int sentences, offsets from pay", PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, PAYLOAD))
def chain_payloads(spark, sf_dir):
    p = E.chain_payload(chained_rows(spark, sf_dir))
    offsets = F.array_join(F.transform("members", lambda m: m["offset"].cast("string")), ",")
    return p.select("doc_id", "chain", "page", "ri", "text", F.size("members").alias("members"), F.size("sentences").alias("sentences"), offsets.alias("offsets"))


_E, _S = r"[.!?…)\"'»\]]\s*$", r"^\s*[A-ZÁÉÍÓÚÜÑ¿¡(\"'«\[]"
MERGED = f"""
ms0 as (select ch.doc_id, ch.chain, ch.ri, s.k, s.text, (row_number() over (partition by ch.doc_id, ch.chain order by ch.ri, s.k) - 1)::int idx, row_number() over (partition by ch.doc_id, ch.chain, ch.ri order by s.k) = 1
   and ch.ri > min(ch.ri) over (partition by ch.doc_id, ch.chain) edge from ch join (select distinct doc_id, page, seq, k, text from sbox) s using (doc_id, page, seq) where chain is not null),
ms1 as (select *, lag(text) over (partition by doc_id, chain order by idx) p from ms0),
ms2 as (select *, not coalesce(edge and not {K.rx('p', r'[:;]\s*$')} and (not {K.rx('p', _E)} or not {K.rx('text', _S)}), false) fresh from ms1),
ms as (select *, (sum(fresh::int) over (partition by doc_id, chain order by idx) - 1)::int m from ms2)"""


@check("merged_sentences", K.sql(f"select doc_id, chain, m, case when count(*) = 1 then min(text) else {K.norm('string_agg(text, chr(32) order by idx)')} end text, string_agg(idx::varchar, ',' order by idx) orig from ms group by doc_id, chain, m",
                                 PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, MERGED))
def merged_sentences(spark, sf_dir):
    p = E.merged_sentences(E.chain_payload(chained_rows(spark, sf_dir)))
    both = F.arrays_zip("merged", "merged_to_orig")
    return p.select("doc_id", "chain", F.posexplode(both).alias("m", "x")).select(
        "doc_id", "chain", "m", F.col("x.merged.text").alias("text"), F.array_join(F.transform("x.merged_to_orig", lambda k: k.cast("string")), ",").alias("orig"))


@check("sentence_merge_groups", K.sql("select doc_id, chain, idx k, m from ms", PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, MERGED))
def sentence_merge_groups(spark, sf_dir):
    p = E.chain_payload(chained_rows(spark, sf_dir))
    flat = p.select("doc_id", "chain", "boundaries", F.posexplode("sentences").alias("k", "s")).select(
        "doc_id", "chain", "k", "s.text", F.array_contains("boundaries", F.col("k")).alias("at_boundary"))
    return E.sentence_merge_groups(flat).select("doc_id", "chain", "k", "m")


@check("chain_members", K.sql("""select doc_id, min(ri) filter ("role" = 'paragraph') idx, 'paragraph' kind, ctext text, string_agg(ri::varchar, ',' order by ri) members
   from (select ch.*, pay.text ctext from ch join pay using (doc_id, chain)) group by doc_id, ctext
   union all select doc_id, ri, 'figure', '', ri::varchar from pl where "role" in ('figure','table')""", PLAIN, *_SENTS, LINEAR_FLOW, CHAINS, PAYLOAD))
def chain_members(spark, sf_dir):
    rows = chained_rows(spark, sf_dir)
    out = VW.chain_members(rows, E.chain_payload(rows))
    return out.withColumn("members", F.array_join(F.transform("members", lambda i: i.cast("string")), ","))


FLOATS = """select doc_id, page, ri, "role", ri idx, (case when hoist then head when defer then coalesce(tail, 2147483647) else ri end)::int slot,
   case when hoist then -1 when defer then 1 else 0 end rank, para and not goes is_tail from (
   select *, not para and not bridged and "role" = 'callout' and coalesce(head > coalesce(done, -1), false) and goes hoist, not para and not bridged and goes
     and not ("role" = 'callout' and coalesce(head > coalesce(done, -1), false)) defer from (
   select *, min(ri) filter (para and not goes) over nxt tail, max(ri) filter (para and not goes) over prv done, max(ri) filter (para and goes and not coalesce(before, false)) over prv head from (
   select *, last_value(case when para then goes end ignore nulls) over (partition by doc_id order by ri rows between unbounded preceding and 1 preceding) before from (
   select *, "role" = 'paragraph' para, "role" = 'equation' and continuation bridged,
     coalesce(first_value(case when "role" = 'paragraph' then continuation end ignore nulls) over (partition by doc_id order by ri rows between 1 following and unbounded following), false) goes from lflow))
   window prv as (partition by doc_id order by ri rows between unbounded preceding and 1 preceding), nxt as (partition by doc_id order by ri rows between 1 following and unbounded following)))"""
_SOME_CALLOUTS = """(select * exclude ("role"), case when ri % 9 = 4 and "role" in ('caption','code') then 'callout' else "role" end "role" from lflow)"""


@check("floats_in_sequence", K.sql(FLOATS.replace("from lflow", f"from {_SOME_CALLOUTS}"), PLAIN, *_SENTS, LINEAR_FLOW))
def floats_in_sequence(spark, sf_dir):
    rows = linear_flow(spark, sf_dir)
    callout = (F.col("ri") % 9 == 4) & F.col("role").isin("caption", "code")
    return VW.sequence_floats(rows.withColumn("role", F.when(callout, "callout").otherwise(F.col("role"))))


@check("page_sequence", K.sql("select doc_id, page, case when kind = 'image' then 'i' else 'p' end kind, ri, x0, y0, x1, y1 from pp", PLAIN))
def page_sequence(spark, sf_dir):
    return VW.reading_sequence_pages(plain_pages(spark, sf_dir))


@check("linear_sequence", K.sql("""select l.doc_id, l.ri idx, case l."role" when 'paragraph' then 'p' when 'title' then 'h' else 'i' end kind, l.ri, f.flat flat_block_ref from pl l
   left join (select doc_id, page, x0, y0, x1, y1, max(flat) flat from (select *, (row_number() over (partition by doc_id order by page, ri) - 1)::int flat from pp where kind = 'block') group by all) f
   on l."role" = 'paragraph' and f.doc_id = l.doc_id and f.page = l.page and f.x0 = l.x0 and f.y0 = l.y0 and f.x1 = l.x1 and f.y1 = l.y1
   where l."role" in ('title','paragraph','figure','table')""", PLAIN))
def linear_sequence(spark, sf_dir):
    return VW.reading_sequence_linear(D.flat_block_refs(plain_linear(spark, sf_dir), plain_pages(spark, sf_dir)))


@check("flat_base", K.sql("select doc_id, page, ri, (row_number() over (partition by doc_id order by page, ri) - 1)::int flat from pp where kind = 'block'", PLAIN))
def flat_base(spark, sf_dir):
    return O.flat_base(plain_pages(spark, sf_dir).where("kind = 'block'")).select(*_key("flat"))


@check("section_outline", K.sql(f"""select doc_id, ri idx, {_ST} text, least(3, length(num) - length(replace(num, '.', '')))::int depth from (select *, regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)', 1) num from pl
   where "role" = 'section_header' and {_ST} <> '')""", PLAIN))
def section_outline(spark, sf_dir):
    return VW.section_outline(plain_linear(spark, sf_dir))


_EMIT = f"emit as (select doc_id, page, x0, y0, x1, y1 from blk where block_type in ('Text','Figure','Caption'))"
_CANDS = f"cands as (select doc_id, page, seq, block_type, lx0 x0, ly0 y0, lx1 x1, ly1 y1 from blk where block_type not in {K.IMAGES} and n_lines > 0)"
_LEFT = f"mleft as (select * from cands c where not exists (select 1 from emit e where e.doc_id = c.doc_id and e.page = c.page and {K.overlap('c.', 'e.')} >= 0.6))"


def _emitted(b):
    return b.where("block_type in ('Text','Figure','Caption')").select("doc_id", "span", "page", *BOX)


@check("metadata_subtract", K.sql("select doc_id, page, seq, block_type from mleft", _EMIT, _CANDS, _LEFT))
def metadata_subtract(spark, sf_dir):
    b = settle(blocks(spark, sf_dir).withColumn("line_text", F.col("text")))
    return D.metadata_subtract(D.metadata_candidates(b), _emitted(b)).select("doc_id", "page", "seq", "block_type")


@check("metadata_self_dedup", K.sql(f"""select doc_id, page, r.seq from (select doc_id, page, unnest(list_reduce(ls, lambda acc, r: case when
   len(list_filter(acc, lambda a: {K.overlap('a.', 'r[1].')} >= 0.6)) > 0 then acc else list_concat(acc, r) end)) r
   from (select doc_id, page, list([{{'seq': seq, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] order by seq) ls from
     (select doc_id, page, seq, x0, case when seq % 2 = 1 then y0 - 165 else y0 end y0, x1, y1 from mleft) group by all))""", _EMIT, _CANDS, _LEFT))
def metadata_self_dedup(spark, sf_dir):
    """Boxes of odd blocks are stretched upwards so that some cover each other."""
    b = settle(blocks(spark, sf_dir).withColumn("line_text", F.col("text")))
    left = D.metadata_subtract(D.metadata_candidates(b), _emitted(b))
    tall = left.withColumn("y0", F.when(F.col("seq") % 2 == 1, F.col("y0") - 165).otherwise(F.col("y0")))
    return D.metadata_self_dedup(tall).select("doc_id", "page", "seq")


@check("emitted_boxes", K.sql("select doc_id, page, x0, y0, x1, y1 from pp union all select doc_id, page, x0, y0, x1, y1 from pl", PLAIN))
def emitted_boxes(spark, sf_dir):
    return D.emitted_boxes(plain_pages(spark, sf_dir), plain_linear(spark, sf_dir)).select("doc_id", "page", *BOX)




@check("nested_and_flat_again", K.sql("""select doc_id, page, ri, kind, "role", case when kind = 'image' then '' else text end text, x0, y0, x1, y1 from pp
   union all select doc_id, page, ri, 'linear', "role", text, x0, y0, x1, y1 from pl""", PLAIN))
def nested_and_flat_again(spark, sf_dir):
    """One nested record per document, taken apart again: nothing is lost."""
    from folioframe import schemas
    from folioframe.sources import catalog, sample_layout

    pages, rows = plain_pages(spark, sf_dir), plain_linear(spark, sf_dir)
    docs = documents(spark, sf_dir)
    info = docs.select("doc_id", F.lit("f").alias("filename"), F.lit(None).cast("string").alias("language"), F.lit(None).cast(schemas.GLOBAL_MAP).alias("global_map"))
    none = rows.where("1 = 0").withColumns({"seq": F.lit(0), "part": F.lit(0), "source_type": F.lit("")})
    linear = rows.withColumns({"flat_block_ref": F.lit(None).cast("int"), "layout_type": F.lit(None).cast("string")})
    flat = catalog.flatten_analysis(catalog.nest_analysis(sample_layout.layout_pages(docs), pages, linear, none, info))
    cols = _key("kind", "role", "text", *BOX)
    return flat["page_rows"].select(cols).unionByName(flat["linear"].withColumn("kind", F.lit("linear")).select(cols))
