"""Order, geometry, footnotes and the two projections of every page."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import sqlkit as K
from checks.registry import blocks, bronze, check, documents, page_tables, table
from checks.text_checks import LINE_SPANS, SENT_BOXES, sentences_sql
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import ordering as O
from folioframe.operators import walk as W
from folioframe.plans import extract as X
from folioframe.sources import catalog, sample_layout

KEYS = ["doc_id", "page", "seq"]


@check("reading_order", K.sql("select doc_id, page, seq, ord from ordered"))
def reading_order(spark, sf_dir):
    return O.reading_order(blocks(spark, sf_dir)).select(*KEYS, "ord")


@check("page_bounds", K.sql("select doc_id, page, lo min_x0, hi max_x1 from bounds"))
def page_bounds(spark, sf_dir):
    return O.page_bounds(blocks(spark, sf_dir)).select("doc_id", "page", "min_x0", "max_x1")


@check("column_kinds", K.sql(f"""select doc_id, page, seq, {K.width_kind('', 'lo', 'hi')} width_kind, {K.column_kind('', 'lo', 'hi')} column_kind,
   {K.layout_type('', 'lo', 'hi')} layout_type from blk join bounds using (doc_id, page)"""))
def column_kinds(spark, sf_dir):
    w = O.page_window()
    b = blocks(spark, sf_dir).withColumns({"lo": F.min("x0").over(w), "hi": F.max("x1").over(w)})
    lo, hi = F.col("lo"), F.col("hi")
    return b.select(*KEYS, G.width_kind(G.box(), lo, hi).alias("width_kind"), G.column_kind(G.box(), lo, hi).alias("column_kind"),
                    G.layout_type(G.box(), lo, hi).alias("layout_type"))


_NEXT = """pair as (select b.*, lead(x0) over w bx0, lead(y0) over w by0, lead(x1) over w bx1, lead(y1) over w by1,
   lead(page) over w bpage, lo alo, hi ahi, lead(lo) over w blo, lead(hi) over w bhi
   from (select * from ordered) b window w as (partition by doc_id order by page, ord)),
pairs as (select doc_id, page, ord, x0 ax0, y0 ay0, x1 ax1, y1 ay1, bx0, by0, bx1, by1, bpage, alo, ahi, blo, bhi, lh from pair where bpage is not null)"""


@check("pair_geometry", K.sql(f"""select doc_id, page, ord, round({K.xov('a', 'b')}, 9) x_ratio, round({K.hov('a', 'b')}, 9) h_ratio, round({K.vov('a', 'b')}, 9) v_ratio,
   round({K.overlap('a', 'b')}, 9) area_ratio, {K.math_adjacent('a', 'b')} math_adjacent,
   {K.hov('a', 'b')} >= 0.35 and by0 - ay1 >= -0.5*least(ay1-ay0, by1-by0) and by1 > ay1 + 2.0 and by0 - ay1 <= greatest(48.0, 0.75*least(ay1-ay0, by1-by0)) stacked,
   {K.vov('a', 'b')} >= 0.4 and bx0 - ax1 >= -2.0 and bx0 - ax1 <= greatest(48.0, 0.75*least(ax1-ax0, bx1-bx0)) side_by_side,
   {K.geometry_ok('a', 'page', 'b', 'bpage', 'lh', '0.0', 'alo', 'ahi', 'blo', 'bhi')} flows,
   case when {K.layout_type('b', 'blo', 'bhi')} = 'right-column' then {K.layout_type('a', 'alo', 'ahi')} in ('left-column','right-column') else true end predecessor_ok
   from pairs""", _NEXT))
def pair_geometry(spark, sf_dir):
    from folioframe.operators import scans
    from folioframe.session import settle

    b = O.reading_order(O.footnote_context(blocks(spark, sf_dir))).drop("body_boxes")
    w = O.page_window()
    b = settle(b.select("doc_id", "span", "page", "ord", "x0", "y0", "x1", "y1", "lh", F.min("x0").over(w).alias("lo"), F.max("x1").over(w).alias("hi")))
    nxt = F.struct("page", "x0", "y0", "x1", "y1", "lo", "hi")
    b = scans.doc_scan(b, ["page", "ord"], b=("next", nxt)).where("b is not null")
    me, o = G.box(), G.box_of("b")
    lo, hi, blo, bhi = F.col("lo"), F.col("hi"), F.col("b.lo"), F.col("b.hi")
    kinds = G.layout_type(me, lo, hi), G.layout_type(o, blo, bhi)
    return b.select(
        "doc_id", "page", "ord", F.round(G.x_overlap_ratio(me, o), 9).alias("x_ratio"), F.round(G.h_overlap(me, o), 9).alias("h_ratio"),
        F.round(G.v_overlap(me, o), 9).alias("v_ratio"), F.round(G.area_overlap(me, o), 9).alias("area_ratio"),
        G.math_adjacent(me, o).alias("math_adjacent"), G.panels_contiguous(me, o).alias("stacked"), G.panels_side_by_side(me, o).alias("side_by_side"),
        G.continuation_geometry_ok(me, F.col("page"), o, F.col("b.page"), F.col("lh"), F.lit(0.0), lo, hi, blo, bhi).alias("flows"),
        G.layout_predecessor_ok(*kinds).alias("predecessor_ok"))


@check("decorative_icons", K.sql("""select doc_id, page, seq from blk where not ((n_lines = 0 or n_lines = 1) and
   (((x1-x0) < 130 and (y1-y0) < 70) or (x1-x0)*(y1-y0) < 12000))"""))
def decorative_icons(spark, sf_dir):
    caption = F.when(F.size("lines") <= 1, "").otherwise(F.col("text"))
    return blocks(spark, sf_dir).where(~G.is_decorative_icon(G.box(), caption)).select(*KEYS)


@check("union_boxes", K.sql("select doc_id, page, seq, lx0 x0, ly0 y0, lx1 x1, ly1 y1, lh from blk where n_lines > 0"))
def union_boxes(spark, sf_dir):
    b = blocks(spark, sf_dir).where("size(lines) > 0").withColumn("u", G.union_bbox("lines"))
    return b.select(*KEYS, *[F.col(f"u.{c}").alias(c) for c in G.Box._fields], G.line_height(F.col("lines")).alias("lh"))


CONTEXT = f"""
pageh as (select l.doc_id, l.page, list_sort(list(l.y1-l.y0)) hs from lines l join blk b using (doc_id, page, seq) where b.block_type in {K.BODY} group by all),
ctx as (select o.*, coalesce(hs[len(hs)//2 + 1], 0.0) body_lh from ordered o left join pageh using (doc_id, page)),
bodyb as (select doc_id, page, lx0 x0, ly0 y0, lx1 x1 from ctx where block_type in {K.BODY} and lh > 0 and body_lh > 0 and lh >= 0.82*body_lh),
resc as (select *, block_type = 'Footnote' and exists (select 1 from blk t where t.doc_id = ctx.doc_id and t.page = ctx.page and t.block_type in {K.TEXTS}
   and t.y0 > ctx.y0 and {K.xov('ctx.', 't.')} >= 0.3) rescued from ctx),
byfont as (select *, body_lh > 0 and lh > 0 and lh <= 0.82*body_lh and not exists (select 1 from bodyb b where b.doc_id = resc.doc_id and b.page = resc.page
   and b.y0 > resc.y1 - 2.0 and (least(resc.x1,b.x1)-greatest(resc.x0,b.x0)) > 0
   and (least(resc.x1,b.x1)-greatest(resc.x0,b.x0)) / least(resc.x1-resc.x0, b.x1-b.x0) >= 0.3) small from resc),
sepc as (select d.doc_id, d.page, round(y0, 2) y from drw d join lay using (doc_id, page) where y1-y0 <= 3.0 and x1-x0 >= 0.3*width and y0 >= 0.72*height),
seps as (select doc_id, page, min(y) sep_y from (select *, y - lag(y) over w up, lead(y) over w - y down from sepc window w as (partition by doc_id, page order by y))
   where coalesce(up > 90, true) and coalesce(down > 90, true) group by all),
callc as (select d.doc_id, d.page, d.x0, d.y0, d.x1, d.y1 from drw d join lay using (doc_id, page) where x1-x0 >= 60 and y1-y0 >= 18 and (x1-x0)*(y1-y0) <= 0.7*width*height
   and (not (fill is null or (fill[1] >= 0.92 and fill[2] >= 0.92 and fill[3] >= 0.92)) or (kind in ('s','fs') and color is not null))),
calll as (select doc_id, page, list([{{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1}}] order by y0, x0) bs from callc group by all),
regs as (select doc_id, page, list_reduce(bs, lambda acc, b: case when len(list_filter(acc, lambda m: not (b[1].x1 < m.x0 or b[1].x0 > m.x1 or b[1].y1 < m.y0 or b[1].y0 > m.y1))) = 0
   then list_concat(acc, b) else list_transform(acc, lambda m, i: case when i = list_position(list_transform(acc, lambda n: not (b[1].x1 < n.x0 or b[1].x0 > n.x1 or b[1].y1 < n.y0 or b[1].y0 > n.y1)), true)
   then {{'y0': least(m.y0, b[1].y0), 'x0': least(m.x0, b[1].x0), 'x1': greatest(m.x1, b[1].x1), 'y1': greatest(m.y1, b[1].y1)}} else m end) end) rs from calll),
region as (select doc_id, page, unnest(rs, recursive := true) from regs)"""


@check("footnote_context", K.sql("select doc_id, page, seq, lh, body_lh, small, rescued from byfont", CONTEXT))
def footnote_context(spark, sf_dir):
    b = O.rescue_footnotes(O.footnote_context(blocks(spark, sf_dir)))
    return b.select(*KEYS, "lh", "body_lh", O.footnote_by_font(b).alias("small"), "rescued")


@check("callout_candidates", K.sql("select doc_id, page, x0, y0, x1, y1 from callc", CONTEXT))
def callout_candidates(spark, sf_dir):
    d = documents(spark, sf_dir)
    return O.callout_candidates(sample_layout.drawings(d), sample_layout.layout_pages(d))


@check("callout_regions", K.sql("select doc_id, page, x0, y0, x1, y1 from region", CONTEXT))
def callout_regions(spark, sf_dir):
    d = documents(spark, sf_dir)
    r = O.merge_callout_regions(O.callout_candidates(sample_layout.drawings(d), sample_layout.layout_pages(d)))
    return r.select("doc_id", "page", F.inline("regions")).select("doc_id", "page", "x0", "y0", "x1", "y1")


@check("separator_candidates", K.sql("select doc_id, page, y from sepc", CONTEXT))
def separator_candidates(spark, sf_dir):
    d = documents(spark, sf_dir)
    return O.separator_candidates(sample_layout.drawings(d), sample_layout.layout_pages(d))


@check("isolated_separator", K.sql("select doc_id, page, sep_y from seps", CONTEXT))
def isolated_separator(spark, sf_dir):
    d = documents(spark, sf_dir)
    return O.isolated_separator(O.separator_candidates(sample_layout.drawings(d), sample_layout.layout_pages(d)))


@check("in_callout_and_below_separator", K.sql(f"""select doc_id, page, seq, coalesce(b.y0 >= sep_y - 2.0, false) below,
   exists (select 1 from region r where r.doc_id = b.doc_id and r.page = b.page and {K.inter('b.', 'r.')} >= 0.6*greatest(1e-6, {K.area('b.')})) inside
   from blk b left join seps using (doc_id, page)""", CONTEXT))
def in_callout_and_below_separator(spark, sf_dir):
    on_page = page_tables(spark, sf_dir)
    b = O.with_drawings(blocks(spark, sf_dir), on_page["drawings"], on_page["layout_pages"])
    return b.select(*KEYS, O.below_separator().alias("below"), O.in_callout().alias("inside"))


@check("has_abstract", K.sql(f"select doc_id, bool_or(page <= 2 and (block_type = 'SectionHeader' or block_type in {K.TEXTS}) and {K.abstract_header('text')}) has_abstract from blk group by all"))
def has_abstract(spark, sf_dir):
    return O.documents_with_abstract(blocks(spark, sf_dir))


@check("native_text_layer", K.sql(f"""select doc_id, bool_and(length({K.strip('t')}) >= 50) native from
   (select doc_id, page, case when (doc_id+page) % 17 = 0 then '' else string_agg(wording, chr(10) order by i) end t from plan group by doc_id, page) group by doc_id"""))
def native_text_layer(spark, sf_dir):
    return catalog.has_native_text_layer(sample_layout.page_text(documents(spark, sf_dir)))


@check("page_density", K.sql("""select doc_id, coalesce(n, 1) page_count, n_chars / 1e6 / greatest(1, coalesce(n, 1)) mb_per_page from documents
   left join (select doc_id, count(*) n from lay group by all) using (doc_id)"""))
def page_density(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return catalog.page_density(files, sample_layout.layout_pages(documents(spark, sf_dir)))


# -- the walk --------------------------------------------------------------------------------------------

_LATEX = K.strip("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')")
WALK = f"""
wa as (select f.*, sep_y, case when rescued then 'Text' else block_type end bt, f.text line_text from byfont f left join seps using (doc_id, page)),
wb as (select * exclude (text), case when bt = 'Equation' and {_LATEX} <> '' then {_LATEX} else text end text,
   case when rescued and n_lines > 0 then lx0 else x0 end tx0, case when rescued and n_lines > 0 then ly0 else y0 end ty0,
   case when rescued and n_lines > 0 then lx1 else x1 end tx1, case when rescued and n_lines > 0 then ly1 else y1 end ty1 from wa),
wc as (select *, bt in {K.TEXTS} is_text, bt in {K.BODY} is_body, bt = 'SectionHeader' and text <> '' hn,
   {K.stop_header('text')} stopw, {K.skip_section('text')} skipw, {K.body_name('text')} bodyw, {K.abstract_header('text')} absw,
   ({K.skip_section('line_text')} or {K.skip_inline('line_text')}) inl, {K.metadata_block('line_text')} meta, {K.n_words('text')} >= 3 long,
   ((small or coalesce(y0 >= sep_y - 2.0, false)) and not {K.caption_like('text')} and not {K.source_line('text')}) or {K.strong_prefix('text')} notey,
   {K.rx('text', K.LICENSE, 'i')} lic, {K.rx('text', K.HARD, 'i')} hard, {K.contact('text')} cont, {K.soft('text')} soft, {K.author_line('text')} auth, {K.dense_names('text')} dense
   from wb),
wd as (select *, bool_or(page <= 2 and (block_type = 'SectionHeader' or block_type in {K.TEXTS}) and {K.abstract_header('line_text')}) over (partition by doc_id) has_abs,
   case when hn and not stopw then skipw::int when is_body and inl then 1 end ev, is_body and not rescued and notey note from wc),
we as (select *, has_abs and coalesce(last_value(ev ignore nulls) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding), 0) = 1 p_skip,
   has_abs and coalesce(last_value(ev ignore nulls) over (partition by doc_id order by page, ord rows between unbounded preceding and 1 preceding), 0) = 1 l_skip,
   hn and not stopw and not (has_abs and skipw) heads from wd),
wf as (select *, page = 1 and has_abs and not coalesce(bool_or(heads and bodyw) over b, false) mast, heads and page = 1 and not coalesce(bool_or(heads) over b, false) is_title,
   is_text and not p_skip and not (has_abs and is_body and inl) and long and not (is_body and meta) p_alive,
   is_text and not l_skip and not (has_abs and is_body and inl) and long and not (is_body and meta) l_alive
   from we window b as (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding)),
wg as (select *, min(page*100000 + ord) filter ((hn and stopw) or (p_alive and not note and stopw)) over d p_stop,
   min(page*100000 + ord) filter ((hn and stopw) or (l_alive and not note and stopw)) over d l_stop,
   min(page*100000 + ord) filter (heads and absw) over d abs_pos, arg_min(y0, page*100000 + ord) filter (heads and absw) over d abs_y from wf window d as (partition by doc_id)),
wh as (select *, coalesce(page*100000 + ord < p_stop, true) p_live, coalesce(page*100000 + ord < l_stop, true) l_live, coalesce(page <= p_stop // 100000, true) p_page,
   exists (select 1 from region r where r.doc_id = wg.doc_id and r.page = wg.page and {K.inter('wg.', 'r.')} >= 0.6*greatest(1e-6, {K.area('wg.')})) p_box,
   exists (select 1 from region r where r.doc_id = wg.doc_id and r.page = wg.page and {K.inter('wg.t', 'r.')} >= 0.6*greatest(1e-6, {K.area('wg.t')})) l_box,
   abs_pos is not null and coalesce(abs_pos < l_stop, true) abs_ok, page = 1 and mast and (soft or auth or dense) masthead from wg),
wi as (select *, case when p_live then case when bt = 'Footnote' then 'note' when bt in {K.IMAGES} then 'image' when p_alive then case when note then 'note'
     when not stopw and not lic and not (page = 1 and (hard or cont or masthead)) then 'block' end end end p_kind,
   case when l_live then case when bt = 'Footnote' then 'note' when heads then 'block' when bt in {K.IMAGES} then 'block' when l_alive then case when note then 'note'
     when not stopw and not lic and not (page = 1 and hard) then 'block' end end end l_kind from wh),
wj as (select *, case p_kind when 'image' then case when bt = 'Table' then 'table' else 'figure' end when 'block' then
     case when {K.text_role('bt')} = 'paragraph' and p_box then 'callout' else {K.text_role('bt')} end end p_role,
   case when l_kind = 'block' then case when hn then case when is_title then 'title' when bodyw then 'section_header' when mast and (soft or auth) then 'author' else 'section_header' end
     when bt in {K.IMAGES} then case when bt = 'Table' then 'table' else 'figure' end
     when page = 1 and (cont or masthead) then 'author' when {K.text_role('bt')} = 'paragraph' and l_box then 'callout' else {K.text_role('bt')} end end l_role0,
   arg_min(y0, ord) filter (heads and bodyw and absw and p_live) over (partition by doc_id, page) abs_top from wi),
w as (select *, case when abs_ok and l_role0 = 'paragraph' and page = abs_pos // 100000 and ty1 <= abs_y + 4 then 'author' else l_role0 end l_role,
   coalesce(sum(case when p_kind in ('block','image') then 1 else 0 end) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding), 0)::int p_ri,
   coalesce(sum(case when l_kind = 'block' then 1 else 0 end) over (partition by doc_id order by page, ord rows between unbounded preceding and 1 preceding), 0)::int l_ri,
   p_kind = 'block' and abs_top is not null and y1 <= abs_top + 4 above from wj)"""


def notes_sql(kind, role, prefix):
    b = f"h.{prefix}"
    return f"""fn as (select doc_id, page, ord, {K.symbol('text')} sym, text, case when block_type = 'Footnote' and n_lines > 0 then lx0 else x0 end nx0,
     case when block_type = 'Footnote' and n_lines > 0 then ly0 else y0 end ny0, case when block_type = 'Footnote' and n_lines > 0 then lx1 else x1 end nx1,
     case when block_type = 'Footnote' and n_lines > 0 then ly1 else y1 end ny1,
     case when lh > 0 and body_lh > 0 then greatest(1.0, least(2.0, body_lh / lh)) else 1.0 end scale from w where {kind} = 'note' and {K.symbol('text')} <> ''),
   cand as (select fn.*, h.ord hord, {b}y0 hy0, h.sup and sym = '†' by_sup, contains(h.text, sym) by_text,
     {b}y0 < ny0 and {K.xov(b, 'fn.n')} >= 0.3 above from fn join w h on h.doc_id = fn.doc_id and h.page = fn.page and h.ord < fn.ord
     and h.{kind} = 'block' and h.{role} = 'paragraph'),
   pick as (select doc_id, page, ord, sym, text, nx0, ny0, nx1, ny1, scale, coalesce(max(hord) filter (by_sup),
     case when count(*) filter (by_text) = 1 then max(hord) filter (by_text) end,
     case when count(*) filter (by_text) > 1 and (length(sym) > 1 or contains('†‡§¶‖∥', sym)) then arg_max(hord, {{'y': hy0, 'o': -hord}}) filter (by_text and above) end) host
     from cand group by doc_id, page, ord, sym, text, nx0, ny0, nx1, ny1, scale),
   attached as (select p.*, h.{kind[0]}_ri host_ri from pick p join w h on h.doc_id = p.doc_id and h.page = p.page and h.ord = p.host)"""


@check("footnotes_of_pages", K.sql("""select a.doc_id, a.page, host_ri ri, a.sym marker, a.text, nx0 x0, ny0 y0, nx1 x1, ny1 y1, scale from attached a
   join w h on h.doc_id = a.doc_id and h.page = a.page and h.ord = a.host where not h.above""", CONTEXT, WALK, notes_sql("p_kind", "p_role", "")))
def footnotes_of_pages(spark, sf_dir):
    return _notes(X.extract_pages(bronze(spark, sf_dir)))


@check("footnotes_of_linear", K.sql("select doc_id, page, host_ri ri, sym marker, text, nx0 x0, ny0 y0, nx1 x1, ny1 y1, scale from attached", CONTEXT, WALK, notes_sql("l_kind", "l_role0", "t")))
def footnotes_of_linear(spark, sf_dir):
    return _notes(X.extract_linear(bronze(spark, sf_dir)))


def _notes(rows):
    return rows.select("doc_id", "page", "ri", F.explode("footnotes").alias("f")).select(
        "doc_id", "page", "ri", "f.marker", "f.text", *[F.col(f"f.bbox.{c}").alias(c) for c in G.Box._fields], F.col("f.font_scale").alias("scale"))


_COUNTS = "scount as (select doc_id, page, seq, count(distinct k)::int n_sentences, count(*)::int n_boxes from sbox group by all)"


def _n_boxes():
    return F.aggregate("sentences", F.lit(0), lambda a, s: a + F.size(s["boxes"]))


@check("extracted_pages", K.sql("""select doc_id, page, p_ri ri, p_kind kind, p_role as "role", case when p_kind = 'block' then text else '' end text, x0, y0, x1, y1,
   case when p_kind = 'block' then coalesce(n_sentences, 0) else 0 end n_sentences, case when p_kind = 'block' then coalesce(n_boxes, 0) else 0 end n_boxes
   from w left join scount using (doc_id, page, seq) where p_kind in ('block','image') and not above""",
   CONTEXT, WALK, sentences_sql("(select doc_id, page, seq, text from w where p_kind = 'block')"), LINE_SPANS, SENT_BOXES, _COUNTS))
def extracted_pages(spark, sf_dir):
    return X.extract_pages(bronze(spark, sf_dir)).select(
        "doc_id", "page", "ri", "kind", "role", "text", "x0", "y0", "x1", "y1", F.size("sentences").alias("n_sentences"), _n_boxes().alias("n_boxes"))


@check("extracted_linear", K.sql("""select doc_id, page, l_ri ri, l_role as "role", case when bt in ('Figure','Picture','Table') then '' else text end text, tx0 x0, ty0 y0, tx1 x1, ty1 y1,
   case when l_role0 in ('paragraph','equation') then coalesce(n_sentences, 0) else 0 end n_sentences
   from w left join scount using (doc_id, page, seq) where l_kind = 'block'""",
   CONTEXT, WALK, sentences_sql("(select doc_id, page, seq, text from w where l_kind = 'block' and l_role0 in ('paragraph','equation'))"), LINE_SPANS, SENT_BOXES, _COUNTS))
def extracted_linear(spark, sf_dir):
    return X.extract_linear(bronze(spark, sf_dir)).select(
        "doc_id", "page", "ri", "role", "text", "x0", "y0", "x1", "y1", F.size("sentences").alias("n_sentences"))


@check("skip_and_masthead_state", K.sql("""select doc_id, page, ord, p_skip page_skip, l_skip document_skip, mast masthead, is_title from wf""", CONTEXT, WALK))
def skip_and_masthead_state(spark, sf_dir):
    b = bronze(spark, sf_dir)
    from folioframe.sources.layout import read_layout

    w = W.states(W.judge(read_layout(b["layout_blocks"]), b["drawings"], b["layout_pages"]))
    return w.select("doc_id", "page", "ord", F.col("p_skip").alias("page_skip"), F.col("l_skip").alias("document_skip"), "masthead", "is_title")


@check("emitted_page_list", K.sql("select doc_id, page, round(width, 2) width, round(height, 2) height from lay left join (select doc_id, min(p_stop // 100000) stop from w group by all) using (doc_id) where stop is null or page <= stop", CONTEXT, WALK))
def emitted_page_list(spark, sf_dir):
    b = bronze(spark, sf_dir)
    return W.emitted_pages(X.walked(b), b["layout_pages"])
