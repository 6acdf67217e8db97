"""SQL text the oracles share: the sample layout, geometry, and the walk over a document, for DuckDB."""

# Fixed values, as in folioframe/functions/fixed_values.py, in the notation of DuckDB's patterns.
S = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NS = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}\p{M}_]"
PROPER = rf"[A-ZÁÉÍÓÚÑÜ](?:{WORD}|['’\-])*"
TEXTS = "('Text','TextInlineMath','ListItem','ListGroup','Caption','Code','Equation','ComplexRegion')"
BODY = "('Text','TextInlineMath','ListItem','ListGroup')"
IMAGES = "('Figure','Picture','Table')"
DROPS = "('PageHeader','PageFooter','Footnote','Reference','TableOfContents','Handwriting','Form')"
STOPS = r"(?:acknowledg(?:e)?ments?|references?|bibliography|works?\s+cited)"
SKIPS = (
    r"(?:ccs\s+concepts?|keywords?|key\s+words?|index\s+terms?|categories\s+and\s+subject\s+descriptors|"
    r"acm\s+reference\s+format|general\s+terms?)"
)
BODIES = (
    r"(?:abstract|introduction|background|related\s+work|prior\s+work|motivation|methods?|methodology|"
    r"materials\s+and\s+methods|experiments?|experimental\s+(?:setup|results?|evaluation|methodology)|results?|"
    r"evaluation|analysis|discussion|conclusion|conclusions?(?:\s+and\s+(?:future|proposed)\s+work)?|future\s+work|"
    r"summary|appendix|preliminaries|notation|problem\s+statement|overview|design|implementation|architecture|"
    r"system\s+(?:design|model|architecture)|approach|proposed\s+(?:method|approach|system)|limitations|"
    r"threats\s+to\s+validity)"
)
HARD = (
    r"\bpermission\s+to\s+(?:make|copy|reproduce|distribute)\b|\b(?:acm|ieee)\s+(?:reference\s+format|copyright)\b|"
    r"\bisbn\s*[\d\-]+|\bdoi[.:\s]+\S+|\bdoi\.org\b|\barxiv(?:\.org)?\b|\bpreprint\b|\bunder\s+review\b|"
    r"\bsubmitted\s+to\b|\bpublication\s+rights\b"
)
LICENSE = (
    r"\bcreative\s+commons\b|\bcc\s+by(?:[- ]?(?:nc|sa|nd))*(?:\s+\d+(?:\.\d+)?)?\b|"
    r"\battribution(?:[- ](?:non[- ]?commercial|share[- ]?alike|no[- ]?derivatives))*\s+\d+(?:\.\d+)?\s+international(?:\s+license)?\b|"
    r"\b(?:licen[sc]ed?|distributed|made\s+available)\s+under\s+(?:a\s+|the\s+)?(?:creative\s+commons|cc\s+by|gnu|mit|bsd|apache|gpl)\b|"
    r"\bcreativecommons\.org\S*|©\s*\d{4}|\(c\)\s*\d{4}|\bcopyright\s+(?:©|\(c\))?\s*(?:held|notice|\d{4})"
)
SOFT = (
    r"@|\buniversit(?:y|ies)\b|\binstitute\b|\bdepartment\b|\bcollege\b|\baffiliation\b|\bschool\s+of\b|"
    r"\blab(?:oratory|oratories)?\b|\b(?:e-?mail|correspondence|corresponding\s+author)\b|\bproceedings\s+of\b|"
    r"\bconference\s+on\b|\bin\s+proceedings\b|\bworkshop\s+on\b"
)
CAPTIONS = (
    r"(?:figure|figura|fig\.?|table|tabla|tab\.?|cuadro|image|imagen|img\.?|esquema|diagrama|schema|diagram|chart)"
)
SYMBOLS = r"[*†‡§¶‖∥#⁂⁑⁎∗]"
STRIP = "0123456789.,;:*†‡§¶∗·¹²³⁴⁵⁶⁷⁸⁹⁰()[]{}"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rx(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {q((f'(?{flags})' if flags else '') + pattern)})"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{S}+|{S}+$')}, '', 'g')"


def lstrip(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{S}+')}, '')"


def rstrip(t: str) -> str:
    return f"regexp_replace({t}, {q(f'{S}+$')}, '')"


def norm(t: str) -> str:
    return strip(f"regexp_replace({t}, {q(S + '+')}, ' ', 'g')")


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {q(NS + '+')})"


def n_words(t: str) -> str:
    return f"len({words(t)})"


def stop_header(t):
    t = strip(t)
    return f"({rx(t, rf'^(?:\d+[.\s]+)?{STOPS}\b[\s:.]*$', 'i')} or {rx(t, rf'^(?:(?:\d+|[ivxlcdm]+)[.\s]+)?{STOPS}\s*[.:—]\s+\S', 'i')})"


def skip_section(t):
    return rx(strip(t), rf"^{SKIPS}\b[\s:.]*$", "i")


def skip_inline(t):
    return rx(strip(t), rf"^{SKIPS}\s*[:.–—]\s*\S", "i")


def body_name(t):
    return rx(strip(t), rf"^(?:\d+(?:\.\d+)*[.\s]+)*{BODIES}\b", "i")


def after(t, pattern):
    """What follows the match of an anchored pattern, or null."""
    m = f"regexp_extract({t}, {q('(?i)' + pattern)})"
    return f"(case when {rx(t, pattern, 'i')} then {lstrip(f'substr({t}, length({m}) + 1)')} end)"


def metadata_block(t):
    rest = after(lstrip(t), r"^(?:keywords?|key\s*words?|supplement(?:al|ary)\s+materials?)\b")
    return f"coalesce({rest} = '' or left({rest}, 1) in (':','：','.','-','–','—'), false)"


def abstract_header(t):
    return rx(strip(t), r"^(?:\d+[.\s]*)?(?:abstract|resumen)\b", "i")


def soft(t):
    return f"({n_words(t)} <= 60 and {rx(t, SOFT, 'i')})"


def count_of(t, ch):
    return f"(length({t}) - length(replace({t}, '{ch}', '')))"


def author_line(t):
    w = words(t)
    proper = f"len(list_filter({w}, lambda w: {rx('w', f'^{PROPER}$')}))"
    return f"({n_words(t)} between 1 and 18 and {count_of(t, '.')} <= 2 and {count_of(t, ';')} <= 2 and {proper} >= greatest(2, {n_words(t)} - 4))"


def proper_count(t):
    return f"len(list_filter({words(t)}, lambda w: {rx(f'trim(w, {q(STRIP)})', f'^{PROPER}$')}))"


def dense_names(t):
    return f"({n_words(t)} >= 4 and {proper_count(t)} >= 0.6 * {n_words(t)})"


def contact(t):
    t = strip(t)
    email = rf"(?:[^@,;()<>\s])+@(?:[^@,;()<>\s])+\.[A-Za-z]{{2,}}"
    return f"({t} <> '' and ({rx(t, email)} or ({rx(t, SOFT, 'i')} and {proper_count(t)} >= 0.4 * {n_words(t)} and right({t}, 1) not in ('.','?','!','…'))))"


def unterminated(t):
    body = f"rtrim({t}, ' ' || chr(9) || chr(10) || chr(13) || '\"''”’»)]}}')"
    return f"({body} <> '' and right({body}, 1) not in ('.','!','?','…'))"


def bullet(t):
    return rx(t, rf"^{S}*(?:[-*–—•◦‣·∙▪▫]|\(?[a-z]\)|\(?\d{{1,3}}[.)]|[ivxlcdm]{{1,4}}[.)]){S}+{NS}", "i")


def caption_like(t):
    rest = after(lstrip(t), rf"^{CAPTIONS}\s*(?:[IVXLCDM]+|\d+)?\b")
    return f"coalesce({rest} = '' or {rx(rest, r'^[.:—–\p{Lu}\p{Nd}]')}, false)"


def lower_start(prev, new):
    return f"({rx(new, rf'^{S}*\p{{Ll}}')} and {rx(prev, NS)})"


def source_line(t):
    return rx(t, r"^(?:source|fuente)\s*:", "i")


def subfigure(t):
    return rx(strip(t), r"^(?:(?i:\(\s*(?:[a-z]|[ivxlcdm]{1,4})\s*[).．。）])|[a-z]\s*[).．。）]|[ivxlcdm]{1,4}\s*[).．。）])")


def table_note(role, t):
    return f"({role} in ('paragraph','caption') and {rx(t, rf'^{S}*(?:(?:notes?|notas?)\s*[.:—–]|\*|[a-z][.)]\s)', 'i')})"


def table_label(role, t):
    return f"({role} in ('paragraph','caption','section_header') and {rx(t, rf'^{S}*(?:table|tabla)\b', 'i')} and {caption_like(t)})"


def algorithm_header(t):
    return rx(t, rf"^{S}*Algorithm\s+\d+\b", "i")


def label_only(t):
    return rx(t, rf"^{S}*Algorithm\s+\d+\s*[:.\-—]?\s*$", "i")


def symbol(t):
    return f"regexp_extract({t}, {q(f'^{S}*({SYMBOLS}+)')}, 1)"


def strong_prefix(t):
    s = symbol(t)
    rest = f"substr({t}, length(regexp_extract({t}, {q(f'^{S}*{SYMBOLS}+')})) + 1, 1)"
    return f"({s} <> '' and (length({s}) > 1 or contains('†‡§¶‖∥', {s})) and not {rx(rest, r'^\p{Nd}')})"


def text_role(bt):
    return f"(case {bt} when 'Caption' then 'caption' when 'Equation' then 'equation' when 'Code' then 'code' else 'paragraph' end)"


# -- geometry: a box is named by an alias or prefix ------------------------------------------------------


def _b(p):
    return [f"{p}{c}" for c in ("x0", "y0", "x1", "y1")]


def xov(a, b):
    ax0, _, ax1, _ = _b(a)
    bx0, _, bx1, _ = _b(b)
    inter = f"(least({ax1},{bx1}) - greatest({ax0},{bx0}))"
    return f"(case when {inter} > 0 then {inter} / least({ax1}-{ax0},{bx1}-{bx0}) else 0.0 end)"


def hov(a, b):
    ax0, _, ax1, _ = _b(a)
    bx0, _, bx1, _ = _b(b)
    return f"(greatest(0.0, least({ax1},{bx1}) - greatest({ax0},{bx0})) / greatest(1e-6, least({ax1}-{ax0},{bx1}-{bx0})))"


def vov(a, b):
    _, ay0, _, ay1 = _b(a)
    _, by0, _, by1 = _b(b)
    return f"(greatest(0.0, least({ay1},{by1}) - greatest({ay0},{by0})) / greatest(1e-6, least({ay1}-{ay0},{by1}-{by0})))"


def inter(a, b):
    ax0, ay0, ax1, ay1 = _b(a)
    bx0, by0, bx1, by1 = _b(b)
    return f"(greatest(0.0, least({ax1},{bx1}) - greatest({ax0},{bx0})) * greatest(0.0, least({ay1},{by1}) - greatest({ay0},{by0})))"


def area(a):
    x0, y0, x1, y1 = _b(a)
    return f"(({x1}-{x0})*({y1}-{y0}))"


def overlap(a, b):
    return f"(case when {inter(a, b)} <= 0 then 0.0 else {inter(a, b)} / greatest(1e-6, least({area(a)},{area(b)})) end)"


def spans_page(p, lo, hi):
    x0, _, x1, _ = _b(p)
    w, mid = f"({hi}-{lo})", f"({lo} + ({hi}-{lo})/2)"
    return f"({w} <= 0 or ({x0} <= {lo} + 0.12*{w} and {x1} >= {hi} - 0.12*{w}) or ({x0} < {mid} - 0.05*{w} and {x1} > {mid} + 0.05*{w}))"


def layout_type(p, lo, hi):
    x0, _, x1, _ = _b(p)
    return f"(case when {spans_page(p, lo, hi)} then 'one-column' when ({x0}+{x1})/2 < {lo} + ({hi}-{lo})/2 then 'left-column' else 'right-column' end)"


def width_kind(p, lo, hi):
    x0, _, x1, _ = _b(p)
    f = f"(({x1}-{x0})/nullif({hi}-{lo},0))"
    return f"(case when {hi}-{lo} <= 0 then 'mid' when {f} >= 0.7 then 'wide' when {f} <= 0.55 then 'narrow' else 'mid' end)"


def column_kind(p, lo, hi):
    x0, _, x1, _ = _b(p)
    w, mid = f"({hi}-{lo})", f"({lo} + ({hi}-{lo})/2)"
    return f"(case when {w} <= 0 or {x1}-{x0} >= 0.75*{w} then 'full' when {x1} <= {mid} + 0.12*{w} then 'left' when {x0} >= {mid} - 0.12*{w} then 'right' else 'other' end)"


def geometry_ok(a, ap, b, bp, lh, covered, alo, ahi, blo, bhi):
    ax0, ay0, ax1, ay1 = _b(a)
    bx0, by0, bx1, by1 = _b(b)
    wa, wb = width_kind(a, alo, ahi), width_kind(b, blo, bhi)
    narrower = f"least({ax1}-{ax0},{bx1}-{bx0})"
    same = f"({narrower} > 0 and (least({ax1},{bx1}) - greatest({ax0},{bx0})) / {narrower} >= 0.5)"
    down = f"({by0} >= {ay0} - 2.0 and ({lh} <= 0 or {by0} - {ay1} - {covered} <= 1.5*{lh}))"
    return f"""(case when ({wa} = 'wide' and {wb} = 'narrow') or ({wa} = 'narrow' and {wb} = 'wide') then false
      when {bp} < {ap} then false
      when {bp} > {ap} then {column_kind(a, alo, ahi)} in ('right','full') and {column_kind(b, blo, bhi)} in ('left','full')
      when {same} then {down} else {bx0} >= {ax0} + 0.5*{narrower} and {by0} <= {ay0} + 2.0 end)"""


def math_adjacent(a, b):
    _, ay0, _, ay1 = _b(a)
    _, by0, _, by1 = _b(b)
    return f"({hov(a, b)} >= 0.3 and {by0} - {ay1} <= 2.5*greatest(1.0, least({ay1}-{ay0},{by1}-{by0})))"


def gap_cover(a, b, o):
    _, _, _, ay1 = _b(a)
    _, by0, _, _ = _b(b)
    _, oy0, _, oy1 = _b(o)
    return f"(case when {xov(a, o)} >= 0.3 or {xov(b, o)} >= 0.3 then greatest(0.0, least({by0},{oy1}) - greatest({ay1},{oy0})) else 0.0 end)"


# -- sample layout ---------------------------------------------------------------------------------------

BASE = f"""
pieces as (
  select doc_id, (generate_subscripts(l, 1) - 1)::int i, unnest(l) raw from (
    select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents)),
typed as (
  select *, (i // 8 + 1)::int page, i % 8 slot, (((i % 8) * 5 + doc_id) % 8)::int seq,
    case when i = 0 then 'SectionHeader' else (['SectionHeader','Caption','Figure','Table','Footnote','PageHeader','Equation','ListItem','Code',
      'Reference','Text','Text','Text','Text','Text','TextInlineMath'])[((doc_id*7 + i*5) % 16) + 1] end block_type,
    (doc_id + 3*i) % 19 v from pieces),
plan0 as (
  select *, case
    when block_type = 'SectionHeader' then case when i >= 12 and (doc_id+i) % 5 = 4 then 'References'
      else (['Abstract','1 Introduction','Keywords','2.1 Methods'])[((doc_id+i) % 4) + 1] end
    when block_type = 'Caption' then case when i % 2 = 0 then 'Figure ' || i || ': ' || raw else 'Table ' || i || '. ' || raw end
    when block_type in ('Figure','Table') then ''
    when block_type = 'Footnote' then '† ' || raw
    when v = 0 then '†† ' || raw when v = 1 then 'Note. ' || raw when v = 2 then lower(raw) when v = 3 then '• ' || raw
    when v = 4 then 'Source: ' || raw when v = 5 then raw || ' and †' when v = 6 then raw || ' a@b.org c@d.org'
    when v = 7 then 'Algorithm ' || i || ' ' || raw when v = 8 then '(b) ' || raw when v = 9 then 'Algorithm ' || i || ' :'
    when v = 10 then regexp_replace(raw, '[.!?]+$', '') when v = 11 and i % 3 = 0 then 'Keywords: ' || raw
    when v = 12 then 'a. ' || raw else raw end wording,
    case when slot between 4 and 6 then 310.0 else 50.0 end::double x0, case when slot between 1 and 3 then 290.0 else 550.0 end::double x1,
    case when slot = 0 then 60 when slot = 7 then 680 when slot <= 3 then 160 + 170*(slot-1) else 160 + 170*(slot-4) end::double y0,
    case when block_type = 'Footnote' or (doc_id+i) % 13 = 0 then 7 else 10 end h from typed),
plan1 as (select *, case when wording = '' then []::varchar[] else string_split(wording, ' ') end ws from plan0),
plan2 as (select *, greatest(8, (len(ws) + 11) // 12) per from plan1),
plan as (select *, ((len(ws) + per - 1) // per)::int n_lines,
    y0 + case when block_type in ('Figure','Table') then 120.0 else 12.0*greatest(1, (len(ws) + per - 1) // per) end y1 from plan2),
rawl as (select doc_id, i, page, seq, block_type, wording, n_lines, x0, x1, y0, h, unnest(range(n_lines)) j, per, ws from plan
  where (doc_id*3 + i) % 29 <> 0),
rawt as (select *, array_to_string(ws[j*per+1:j*per+per], ' ') t from rawl),
alll as (select doc_id, page, seq, block_type, j, x0, x1, y0 + 12.0*j y0, y0 + 12.0*j + h y1, j > 0 and (doc_id+j) % 31 = 0 removed,
    {norm("case when block_type = 'TextInlineMath' and j % 2 = 0 then regexp_replace('<math>' || lower(t) || '</math>', '<[^>]+>', '', 'g') else t end")} text
  from rawt),
lines as (select doc_id, page, seq, 0 part, (row_number() over (partition by doc_id, page, seq order by j) - 1)::int ln, text, x0, y0, x1, y1
  from alll where not removed and text <> ''),
linesum as (select doc_id, page, seq, string_agg(text, ' ' order by ln) text, count(*) n, min(x0) lx0, min(y0) ly0, max(x1) lx1, max(y1) ly1,
    coalesce(list_sort(list(y1-y0) filter (y1-y0 > 0))[count(*) filter (y1-y0 > 0)//2 + 1], 0.0) lh from lines group by all),
blk as (select p.doc_id, p.page, p.seq, 0 part, p.i, p.block_type, coalesce(l.text, '') text, p.x0, p.y0, p.x1, p.y1,
    case when p.block_type = 'Equation' and p.doc_id % 3 <> 0 then '<math display="block">' || raw || '</math>' end html,
    p.block_type not in ('Figure','Table') and right(p.wording, 6) = ' and †' and p.doc_id % 2 = 0 sup,
    coalesce(l.n, 0) n_lines, coalesce(l.lh, 0.0) lh, lx0, ly0, lx1, ly1
  from plan p left join linesum l using (doc_id, page, seq) where (p.doc_id*3 + p.i) % 29 <> 0),
lay as (select distinct doc_id, page, 600.0::double width, 800.0::double height from typed),
drw as (
  select doc_id, page, 0::double x0, 0::double y0, 600::double x1, 800::double y1, 'f' kind, [1.0,1.0,1.0]::double[] fill, null::double[] color from lay
  union all select doc_id, page, 50, 660, 300, 661, 's', null, [0.0,0.0,0.0] from lay where (doc_id+page) % 3 = 0
  union all select doc_id, page, 50, y, 300, y+1, 's', null, [0.0,0.0,0.0] from lay, (values (600),(630),(674)) r(y) where (doc_id+page) % 3 = 1
  union all select doc_id, page, 50, 330, 290, 480, 'f', [0.9,0.9,0.9], null from lay where doc_id % 4 = 0
  union all select doc_id, page, 45, 400, 295, 500, 's', null, [0.0,0.0,0.0] from lay where doc_id % 8 = 0
  union all select doc_id, page, 320, 150, 340, 600, 's', null, [0.0,0.0,0.0] from lay where doc_id % 8 = 0),
bounds as (select doc_id, page, min(x0) lo, max(x1) hi from blk group by all),
zoned as (select b.*, lo, hi, case when {spans_page('b.', 'lo', 'hi')} then 2
    when b.x1 - greatest(b.x0, lo+(hi-lo)/2) > least(b.x1, lo+(hi-lo)/2) - b.x0 then 1 else 0 end lane from blk b join bounds using (doc_id, page)),
zones as (select *, coalesce(sum(case when lane = 2 then 1 else 0 end) over (partition by doc_id, page order by y0, seq, part
    rows between unbounded preceding and 1 preceding), 0) zone from zoned),
ordered as (select *, (row_number() over (partition by doc_id, page order by zone, lane, y0, seq, part) - 1)::int ord from zones)
"""


def sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([BASE.strip(), *[c.strip() for c in ctes]]) + "\n" + body
