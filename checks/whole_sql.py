"""SQL of the whole extraction: the pieces of the other checks, one after the other, each on the rows of the one before."""

import re

from checks import sqlkit as K
from checks.flow_checks import (
    _NOTES, _PARA_LH, AUTHORS, BOX, CHAINS, FLOATS, LINEAR_FLOW, MERGED, PAGE_FLOW, PAYLOAD, _algorithms, _bridge, _caption_fold, _PIN, _recursive, _table_fold)
from checks.page_checks import CONTEXT, WALK, notes_sql
from checks.text_checks import LINE_SPANS, SENT_BOXES, sentences_sql


def _named(sql: str, **names: str) -> str:
    """The text with whole words renamed."""
    return re.sub(r"(?<![\w.'])(" + "|".join(names) + r")\b(?!')", lambda m: names[m[1]], sql)


def _numbered(sql: str, mark: str, own: str, **names: str) -> str:
    """The names in ``own`` with a mark, so that a piece can be used twice."""
    return _named(sql, **{n: f"{n}_{mark}" for n in own.split()}, **names)


_SPAN = "min(x0) over (partition by doc_id, page) lo, max(x1) over (partition by doc_id, page) hi"
_ICON = "\"role\" = 'figure' and caption = '' and (((x1-x0) < 130 and (y1-y0) < 70) or (x1-x0)*(y1-y0) < 12000)"
_union = lambda a, b: f"least({a}.x0, {b}.x0) x0, least({a}.y0, {b}.y0) y0, greatest({a}.x1, {b}.x1) x1, greatest({a}.y1, {b}.y1) y1"

# -- the page projection ---------------------------------------------------------------------------------

_CAPTION_NAMES = "ce cf cl cp cm"
_pages_fold = [_numbered(s, "p", _CAPTION_NAMES) for s in _caption_fold(True)]
PAGES = [
    """pp as (select doc_id, page, seq, p_ri ri, p_kind kind, p_role "role", case when p_kind = 'block' then text else '' end text, x0, y0, x1, y1
       from w where p_kind in ('block','image') and not above)""",
    *_pages_fold,
    """cb as (select doc_id, g, "owner", min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from cp_p join ce_p using (doc_id, g, ri) where not panel group by all)""",
    f"""p1 as (select p.doc_id, p.page, p.seq, p.ri, p.kind, p."role", p.text, {_union('p', 'm')}, coalesce(m.cap, '') caption, b.x0 cx0, b.y0 cy0, b.x1 cx1, b.y1 cy1
       from pp p left join cm_p m on m.doc_id = p.doc_id and m."owner" = p.ri and m.g = p.page left join cb b on b.doc_id = p.doc_id and b."owner" = p.ri and b.g = p.page
       where not exists (select 1 from cp_p c where c.doc_id = p.doc_id and c.g = p.page and c.ri = p.ri))""",
    _named(_NOTES, pp="p1"),
    """p2 as (select p.doc_id, p.page, p.seq, p.ri, p.kind, p."role", p.text, least(p.x0, bx0) x0, least(p.y0, by0) y0, greatest(p.x1, bx1) x1, greatest(p.y1, by1) y1,
       concat_ws(chr(10), nullif(p.caption, ''), m.text) caption, least(cx0, bx0) cx0, least(cy0, by0) cy0, greatest(cx1, bx1) cx1, greatest(cy1, by1) cy1
       from p1 p left join (select tp.*, tn.text, bx0, by0, bx1, by1 from tp join tn using (doc_id, page, tri, nri)) m on m.doc_id = p.doc_id and m.page = p.page and m.tri = p.ri
       where not exists (select 1 from tp where tp.doc_id = p.doc_id and tp.page = p.page and tp.nri = p.ri))""",
    _numbered(_algorithms("p2", "('section_header','title','author')", True), "p", "al0 al1 al2 al3 al4 al5 al am amc"),
    """p3 as (select doc_id, page, seq, ri, kind, "role", text, x0, y0, x1, y1, caption, cx0, cy0, cx1, cy1 from al_p where not mem
       union all select a.doc_id, a.page, h.seq, a.ri, 'image', 'algorithm', '', mx0, my0, mx1, my1, a.cap, h.x0, h.y0, h.x1, h.y1 from amc_p a join p2 h using (doc_id, page, ri))""",
    f"p4 as (select *, {_SPAN} from p3 where not ({_ICON}))",
    _named(PAGE_FLOW, pp="p4"),
    _numbered(_bridge("pflow", "doc_id, page, kind"), "p", "br0 br1 br"),
    "pages_done as (select * exclude (continuation, bridged), continuation or bridged continuation from br_p)",
]

# -- the linear projection -------------------------------------------------------------------------------

_linear_fold = [_numbered(s, "l", _CAPTION_NAMES, pl="l1") for s in _caption_fold(False)]
_TABLE_NAMES = "te tg ta tw tz tm"


def _tables(source, mark):
    return [
        _numbered(_table_fold(source), mark, _TABLE_NAMES),
        f"""{mark} as (select p.doc_id, p.page, p.seq, coalesce(m.first_ri, p.ri) ri, p."role", case when m."owner" is null then p.text else coalesce(m.whole, '') end text, {_union('p', 'm')},
           concat_ws(chr(10), nullif(p.caption, ''), m.others) caption from {source} p left join tm_{mark} m on m.doc_id = p.doc_id and m.page = p.page and m."owner" = p.ri
           where not exists (select 1 from tz_{mark} z where z.doc_id = p.doc_id and z.page = p.page and z.ri = p.ri and z.ri <> z."owner"))""",
    ]


LINEAR = [
    """pl as (select doc_id, page, seq, l_ri ri, l_role "role", case when bt in ('Figure','Picture','Table') then '' else text end text, tx0 x0, ty0 y0, tx1 x1, ty1 y1, '' caption from w where l_kind = 'block')""",
    *_tables("pl", "l1"),
    *_linear_fold,
    f"""l2 as (select p.doc_id, p.page, p.seq, p.ri, p."role", p.text, {_union('p', 'm')}, case when m."owner" is not null then coalesce(m.cap, '') else p.caption end caption
       from l1 p left join cm_l m on m.doc_id = p.doc_id and m."owner" = p.ri where not exists (select 1 from cp_l c where c.doc_id = p.doc_id and c.ri = p.ri))""",
    _numbered(_algorithms("l2", "('section_header','title','author','figure','table')", False), "l", "al0 al1 al2 al3 al4 al5 al am amc"),
    """l3 as (select doc_id, page, seq, ri, "role", text, x0, y0, x1, y1, caption from al_l where not mem
       union all select a.doc_id, a.page, h.seq, a.ri, 'algorithm', coalesce(mtext, ''), mx0, my0, mx1, my1, a.cap from amc_l a join l2 h using (doc_id, page, ri))""",
    *_tables("l3", "l4"),
    f"l5 as (select * from l4 where not ({_ICON}))",
    _named(AUTHORS, pl="l5"),
    f"""l6 as (select doc_id, page, seq, case when any_cand then nri else ri end::int ri, case when cand then 'author' else "role" end "role", text, x0, y0, x1, y1, caption,
       case when away and part = 2 then 2 when away and part = 1 and page <> tpage then 1 else 0 end shelf, {_SPAN}
       from (select *, bool_or(part = 1 and page <> tpage) over (partition by doc_id) away from au))""",
    sentences_sql("(select doc_id, page, seq, text from w where l_kind = 'block' and l_role0 in ('paragraph','equation'))"), LINE_SPANS, SENT_BOXES, _PARA_LH,
    _named(LINEAR_FLOW, pl="l6").replace("order by ri", "order by page, ri").replace("lag(ri) over w ari", "lag(ri) over w ari"),
    _numbered(_bridge("lflow", "doc_id, page"), "l", "br0 br1 br"),
    "ld as (select * exclude (continuation, bridged), continuation or bridged continuation from br_l)",
    f"""linear_done as (select p.* exclude (y1), case when ys is null then y1 else list_reduce(ys, lambda a, y: case when a > y + 2.0 then y else a end, y1) end y1 from ld p left join (
       select doc_id, page, target ri, list(y0 order by ri) ys from (select b.doc_id, b.page, b.ri, b.y0, max(a.ri) target, arg_max(a.y0, a.ri) ay0 from ld b join ld a on a.doc_id = b.doc_id and a.page = b.page and a.ri < b.ri
         and a.shelf = b.shelf and {K.xov('a.', 'b.')} >= 0.3 group by b.doc_id, b.page, b.ri, b.y0) where ay0 <= y0 group by doc_id, page, target) using (doc_id, page, ri))""",
]

# -- text that neither projection holds ------------------------------------------------------------------

_NOTE_NAMES = "fn cand pick attached"
_GROUPS = "('Figure','Picture','Table')"
METADATA = [
    _numbered(notes_sql("p_kind", "p_role", ""), "p", _NOTE_NAMES), _numbered(notes_sql("l_kind", "l_role0", "t"), "l", _NOTE_NAMES),
    """emit as (select doc_id, page, x0, y0, x1, y1 from pages_done union all select doc_id, page, x0, y0, x1, y1 from linear_done
       union all select doc_id, page, cx0, cy0, cx1, cy1 from pages_done where kind = 'image' and cx0 is not null
       union all select a.doc_id, a.page, nx0, ny0, nx1, ny1 from attached_p a join w h on h.doc_id = a.doc_id and h.page = a.page and h.ord = a.host join pages_done d on d.doc_id = h.doc_id and d.page = h.page and d.seq = h.seq and d.kind = 'block'
       union all select a.doc_id, a.page, nx0, ny0, nx1, ny1 from attached_l a join w h on h.doc_id = a.doc_id and h.page = a.page and h.ord = a.host join linear_done d on d.doc_id = h.doc_id and d.page = h.page and d.seq = h.seq and d."role" <> 'algorithm')""",
    f"cands as (select doc_id, page, seq, block_type, line_text, lx0 x0, ly0 y0, lx1 x1, ly1 y1 from w where block_type not in {_GROUPS} and n_lines > 0)",
    f"mleft as (select * from cands c where not exists (select 1 from emit e where e.doc_id = c.doc_id and e.page = c.page and {K.overlap('c.', 'e.')} >= 0.6))",
    f"""mkept as (select doc_id, page, unnest(list_transform(list_reduce(ls, lambda acc, r: case when len(list_filter(acc, lambda a: {K.overlap('a.', 'r[1].')} >= 0.6)) > 0 then acc else list_concat(acc, r) end), lambda r: r.seq)) seq
       from (select doc_id, page, list([{{'seq': seq, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] order by seq) ls from mleft group by all))""",
    """meta_done as (select m.* from mleft m join mkept using (doc_id, page, seq) left join (select doc_id, min(p_stop // 100000) stop from w group by all) using (doc_id) where stop is null or page <= stop)""",
]

WHOLE = [CONTEXT, WALK, *PAGES, *LINEAR, *METADATA]


def whole(body: str, *more: str) -> str:
    return _recursive(K.sql(body, *WHOLE, *more))


_B = ", ".join(BOX)
BOTH = whole(f"""select 'page' "table", ri, doc_id, page, "role", text, {_B}, continuation, caption caption_text from pages_done
  union all select 'linear', ri, doc_id, page, "role", text, {_B}, continuation, caption from linear_done
  union all select 'metadata', seq, doc_id, page, block_type, line_text, {_B}, null, null from meta_done""")

# -- the reader's view -----------------------------------------------------------------------------------

# Edits as answer_checks.sample_overrides makes them: by key on some pages, with a box on others.
_by_page = lambda sql: sql.replace("order by ri", "order by page, ri").replace("order by ch.ri", "order by ch.page, ch.ri")
_first = "page * 100000 + ri"
VIEW = [
    """ovk as (select doc_id, page, ri, kind, x0, y0, x1, y1, ri n, case when ri = 1 then 'ignored' end nrole, ri = 2 nocont, ri = 3 pin from pages_done where (doc_id+page) % 6 = 0 and ri in (1,2,3)),
    ovb as (select doc_id, page, page n, x0, y0, x1, y1, 'footnote' nrole from pages_done where (doc_id+page) % 6 = 1 and ri = 0),
    ovp as (select doc_id, page, n, x0, y0, x1, y1, nrole, nocont, pin from ovk where kind = 'block' union all select doc_id, page, n, x0, y0, x1, y1, nrole, false, false from ovb)""",
    """vp as (select p.doc_id, p.page, p.seq, p.ri, p.kind, coalesce(o.nrole, p."role") "role", p.text, p.x0, p.y0, p.x1, p.y1, p.continuation and not (p.kind = 'block' and coalesce(o.nocont, false)) continuation, not coalesce(o.pin, false) allow
       from pages_done p left join ovk o using (doc_id, page, ri))""",
    """flat as (select doc_id, page, x0, y0, x1, y1, max(flat) flat from (select *, (row_number() over (partition by doc_id order by page, ri) - 1)::int flat from pages_done where kind = 'block') group by all)""",
    f"""lv as (select l.* exclude ("role", continuation), coalesce(m.b.r, l."role") "role", l.continuation and not coalesce(m.b.c, false) continuation, coalesce(m.b.p, false) pinned, f.flat,
       (row_number() over (partition by l.doc_id order by l.page, l.ri) - 1)::int idx from linear_done l
       left join (select l.doc_id, l.ri, min_by({{'r': o.nrole, 'c': o.nocont, 'p': o.pin}}, o.n) b from linear_done l join ovp o on o.doc_id = l.doc_id and o.page = l.page and {K.overlap('o.', 'l.')} >= 0.6 group by l.doc_id, l.ri) m using (doc_id, ri)
       left join flat f on l."role" = 'paragraph' and f.doc_id = l.doc_id and f.page = l.page and f.x0 = l.x0 and f.y0 = l.y0 and f.x1 = l.x1 and f.y1 = l.y1
       where coalesce(m.b.r, l."role") <> 'ignored')""",
    f"""mv as (select m.*, coalesce(o.nrole, 'ignored') "role" from meta_done m left join (select m.doc_id, m.page, m.seq, min_by(o.nrole, o.n) nrole from meta_done m join ovb o on o.doc_id = m.doc_id and o.page = m.page and {K.overlap('o.', 'm.')} >= 0.6 group by all) o using (doc_id, page, seq))""",
    f"""extra as (select l.doc_id, l.page, l."role", l.text, l.x0, l.y0, l.x1, l.y1, not pinned allow from lv l join (select distinct doc_id, page, seq from sbox) s using (doc_id, page, seq)
       left join (select doc_id, min(p_stop // 100000) stop from w group by all) using (doc_id) where l."role" = 'paragraph' and (stop is null or l.page <= stop)
       and not exists (select 1 from vp p where p.doc_id = l.doc_id and p.page = l.page and {K.overlap('l.', 'p.')} >= 0.6))""",
    _named(_by_page(CHAINS.replace(_PIN, "pinned")), lflow="lv"),
    _by_page(PAYLOAD).replace("min(ri) ri", f"arg_min(ri, {_first}) ri").replace("arg_min(page, ri)", f"arg_min(page, {_first})"),
    _by_page(MERGED).replace("ch.ri > min(ch.ri) over", "(ch.page * 100000 + ch.ri) > min(ch.page * 100000 + ch.ri) over"),
]
_FLOATS = _named(FLOATS, lflow="(select * exclude (ri), idx ri from lv)")
_NONE = "null::double, null::double, null::double, null::double"
VIEWS = whole(f"""select 'page_rows' "view", doc_id, page, ri place, kind || ' ' || "role" what, text, {_B}, continuation::varchar || ' ' || allow::varchar || ' false' more from vp
  union all select 'page_rows', doc_id, page, null, 'block ' || "role", text, {_B}, 'false ' || allow::varchar || ' true' from extra
  union all select 'linear', doc_id, page, ri, "role", text, {_B}, continuation::varchar || ' ' || coalesce(chain::varchar, '') from ch
  union all select 'payloads', doc_id, page, ri, chain::varchar, text, {_NONE}, members || ' ' || sentences || ' ' || coalesce(k, 0) from pay left join (select doc_id, chain, count(distinct m) k from ms group by all) using (doc_id, chain)
  union all select 'list', doc_id, null, min(idx) filter ("role" = 'paragraph'), 'paragraph', ctext, {_NONE}, string_agg(idx::varchar, ',' order by idx) from (select ch.*, pay.text ctext from ch join pay using (doc_id, chain)) group by doc_id, ctext
  union all select 'list', doc_id, null, idx, 'figure', caption, {_NONE}, idx::varchar from lv where "role" in ('figure','table','algorithm')
  union all select 'page_sequence', doc_id, page, ri, case when kind = 'image' then 'i' else 'p' end, null, {_B}, null from vp
  union all select 'page_sequence', doc_id, page, 0, 'p', null, {_B}, null from extra
  union all select 'linear_sequence', doc_id, null, idx, case "role" when 'paragraph' then 'p' when 'title' then 'h' else 'i' end, null, {_NONE}, ri || ' ' || coalesce(flat::varchar, '') from lv where "role" in ('title','paragraph','figure','table')
  union all select 'outline', doc_id, null, idx, least(3, length(num) - length(replace(num, '.', '')))::varchar, {K.strip('text')}, {_NONE}, null from (select *, regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)', 1) num from lv where "role" = 'section_header' and {K.strip('text')} <> '')
  union all select 'display', doc_id, page, idx, "role", null, {_NONE}, slot || ' ' || rank || ' ' || is_tail from ({_FLOATS})""", *VIEW)
