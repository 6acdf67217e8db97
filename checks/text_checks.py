"""Predicates and scalar functions over the text of every block."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import sqlkit as K
from checks.registry import blocks, check, documents, table
from folioframe.functions import text as T
from folioframe.operators import explain as E
from folioframe.operators import jobs as J
from folioframe.operators import sentences as S
from folioframe.sources import sample_layout

KEYS = ["doc_id", "page", "seq"]


def _over_blocks(name, column, expression, out="flag"):
    @check(name, K.sql(f"select doc_id, page, seq, {expression} as {out} from blk"))
    def run(spark, sf_dir):
        return blocks(spark, sf_dir).select(*KEYS, column().alias(out))


ROLE = K.text_role("block_type")

for _name, _col, _sql in [
    ("stop_header", lambda: T.is_stop_header("text"), K.stop_header("text")),
    ("skip_section", lambda: T.is_skip_section("text"), K.skip_section("text")),
    ("skip_section_inline", lambda: T.is_skip_section_inline("text"), K.skip_inline("text")),
    ("body_section_name", lambda: T.is_body_section_name("text"), K.body_name("text")),
    ("metadata_block", lambda: T.is_metadata_block("text"), K.metadata_block("text")),
    ("abstract_header", lambda: T.is_abstract_header("text"), K.abstract_header("text")),
    ("hard_noise", lambda: T.is_hard_noise("text"), K.rx("text", K.HARD, "i")),
    ("license_noise", lambda: T.is_license_noise("text"), K.rx("text", K.LICENSE, "i")),
    ("soft_noise", lambda: T.is_soft_noise("text"), K.soft("text")),
    ("author_line", lambda: T.looks_like_author_line("text"), K.author_line("text")),
    ("dense_name_list", lambda: T.is_dense_name_list("text"), K.dense_names("text")),
    ("contact_block", lambda: T.is_contact_block("text"), K.contact("text")),
    ("ends_unterminated", lambda: T.ends_unterminated("text"), K.unterminated("text")),
    ("bullet", lambda: T.is_bullet("text"), K.bullet("text")),
    ("caption_like", lambda: T.is_caption_like("text"), K.caption_like("text")),
    ("source_attribution", lambda: T.is_source_attribution(T.text_role("block_type"), "text"),
     f"({ROLE} = 'paragraph' and {K.source_line(K.lstrip('text'))})"),
    ("subfigure_caption", lambda: T.is_subfigure_caption("text"), K.subfigure("text")),
    ("table_label", lambda: T.is_table_label(T.text_role("block_type"), "text"), K.table_label(ROLE, "text")),
    ("table_note", lambda: T.is_table_note(T.text_role("block_type"), "text"), K.table_note(ROLE, "text")),
    ("algorithm_header", lambda: T.is_algorithm_header("text"), K.algorithm_header("text")),
    ("algorithm_label_only", lambda: T.is_algorithm_label_only("text"), K.label_only("text")),
    ("strong_footnote_prefix", lambda: T.strong_footnote_prefix("text"), K.strong_prefix("text")),
    ("enough_words", lambda: T.word_count("text") >= 3, f"{K.n_words('text')} >= 3"),
]:
    _over_blocks(_name, _col, _sql)

_over_blocks("footnote_symbol", lambda: T.leading_footnote_symbol("text"), K.symbol("text"), "symbol")
_over_blocks("equation_latex", lambda: T.equation_latex("html"),
             K.strip("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')"), "latex")
_over_blocks("match_normal_form", lambda: T.normalize_for_match("text"),
             f"regexp_replace(replace(regexp_replace(lower(text), {K.q('-' + K.S + '*')}, '', 'g'), chr(173), ''), {K.q(K.S + '+')}, ' ', 'g')", "form")


def _text_hash(expression):
    """A 32-bit rolling hash in SQL: fold over UTF-16 units (all texts here are in the basic plane)."""
    units = f"list_transform(string_split({expression}, ''), lambda c: ord(c)::bigint)"
    return f"list_reduce({units}, lambda h, u: xor(h * 33, u) & 4294967295, 5381::bigint)"


_DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"
_B36 = "list_reduce(list_transform(range(7), lambda k: substr(" + _DIGITS + ", ((h // (36::bigint ** k)::bigint) % 36)::int + 1, 1)), lambda a, d: d || a)"


@check("block_buckets", K.sql(f"""select doc_id, page, seq, case when block_type in {K.BODY} then 'body_text' when block_type in {K.TEXTS} then 'text'
  when block_type in {K.IMAGES} then 'image' when block_type in {K.DROPS} then 'drop' when block_type = 'SectionHeader' then 'header' else 'other' end bucket,
  {ROLE} text_role, case when block_type = 'Table' then 'table' else 'figure' end image_role from blk"""))
def block_buckets(spark, sf_dir):
    return blocks(spark, sf_dir).select(
        *KEYS, T.block_bucket("block_type").alias("bucket"), T.text_role("block_type").alias("text_role"), T.image_role("block_type").alias("image_role"))


_PREV = "lag(text) over (partition by doc_id, page order by seq)"


@check("starts_lowercase", K.sql(f"select doc_id, page, seq, coalesce({K.lower_start('p', 'text')}, false) flag from (select *, {_PREV} p from blk)"))
def starts_lowercase(spark, sf_dir):
    prev = F.lag("text").over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return blocks(spark, sf_dir).withColumn("p", prev).select(*KEYS, F.coalesce(T.starts_lowercase("p", "text"), F.lit(False)).alias("flag"))


@check("join_hyphen", K.sql(f"""select doc_id, page, seq, case when right({K.rstrip('p')}, 1) in ('-','—','¬')
   then left({K.rstrip('p')}, length({K.rstrip('p')}) - 1) || {K.lstrip('text')} else {K.rstrip('p')} || ' ' || {K.lstrip('text')} end joined
   from (select *, {_PREV} p from blk) where p is not null"""))
def join_hyphen(spark, sf_dir):
    prev = F.lag("text").over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return blocks(spark, sf_dir).withColumn("p", prev).where("p is not null").select(*KEYS, T.join_hyphen("p", "text").alias("joined"))


_END, _START = r"[.!?…)\"'»\]]\s*$", r"^\s*[A-ZÁÉÍÓÚÜÑ¿¡(\"'«\[]"


@check("split_boundary", K.sql(f"""select doc_id, page, seq, not {K.rx('p', r'[:;]\s*$')} and (not {K.rx('p', _END)} or not {K.rx('text', _START)}) flag
   from (select *, {_PREV} p from blk) where p is not null"""))
def split_boundary(spark, sf_dir):
    prev = F.lag("text").over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return blocks(spark, sf_dir).withColumn("p", prev).where("p is not null").select(*KEYS, T.is_split_boundary("p", "text").alias("flag"))


@check("algorithm_captions", K.sql(f"""select doc_id, page, seq, case when {K.label_only(K.strip('text'))} and nr in ('paragraph','caption','code')
   and {K.strip('nt')} <> '' and {K.n_words('nt')} <= 14 and not {K.algorithm_header('nt')}
   then {K.strip('text')} || case when right({K.strip('text')}, 1) in (':','.','-','—') then '' else ':' end || ' ' || {K.strip('nt')} else {K.strip('text')} end caption
   from (select *, lead(text) over w nt, lead({ROLE}) over w nr from blk window w as (partition by doc_id, page order by seq)) where {K.algorithm_header('text')}"""))
def algorithm_captions(spark, sf_dir):
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    rows = blocks(spark, sf_dir).withColumn("nt", F.lead("text").over(w)).withColumn("nr", F.lead(T.text_role("block_type")).over(w))
    return rows.where(T.is_algorithm_header("text")).select(*KEYS, T.algorithm_caption("text", "nt", "nr").alias("caption"))


_STOPS = "(" + ",".join(K.q(w) for w in __import__("folioframe.functions.fixed_values", fromlist=["STOP_WORDS"]).STOP_WORDS) + ")"


def significant_sql(t):
    form = f"regexp_replace(lower({t}), {K.q('[^a-z0-9_áéíóúüñ' + K.S[1:-1] + ']')}, ' ', 'g')"
    return f"list_filter({K.words(form)}, lambda w: length(w) > 2 and w not in {_STOPS})"


@check("significant_words", K.sql(f"select doc_id, page, seq, len(list_distinct({significant_sql('text')}))::int n, array_to_string(list_sort(list_distinct({significant_sql('text')})), ' ') words from blk"))
def significant_words(spark, sf_dir):
    w = T.significant_words("text")
    return blocks(spark, sf_dir).select(*KEYS, F.size(w).alias("n"), F.array_join(F.array_sort(w), " ").alias("words"))


@check("language_names", """select doc_id, case lang when 'es' then 'Spanish' when 'en' then 'English' when 'zh-Hant' then 'Traditional Chinese (繁體中文)'
   else 'English' end language from (select doc_id, coalesce(lang, 'es') lang from documents)""")
def language_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_name("lang").alias("language"))


@check("text_hash", K.sql(f"select doc_id, page, seq, case when ltrim(b, '0') = '' then '0' else ltrim(b, '0') end hash from (select doc_id, page, seq, {_B36} b from (select *, {_text_hash('text')} h from blk where text <> ''))"))
def text_hash(spark, sf_dir):
    return blocks(spark, sf_dir).where("text <> ''").select(*KEYS, E.djb2_base36(F.col("text")).alias("hash"))


@check("explain_cache_keys", K.sql(f"""select doc_id, page, seq, 'explain:v3:en:doc' || doc_id || '.pdf:' || case when ltrim(b, '0') = '' then '0' else ltrim(b, '0') end as "key"
   from (select doc_id, page, seq, {_B36} b from (select *, {_text_hash('tag')} h from (select *, case when block_type in ('Figure','Table')
   then lower(block_type) || ':' || page || ':' || regexp_replace(x0::varchar, '\\.0$', '') || ',' || regexp_replace(y0::varchar, '\\.0$', '') || ',' || regexp_replace(x1::varchar, '\\.0$', '') || ',' || regexp_replace(y1::varchar, '\\.0$', '')
   else text end tag from blk) where tag <> ''))"""))
def explain_cache_keys(spark, sf_dir):
    role = F.when(F.col("block_type").isin("Figure", "Table"), F.lower("block_type")).otherwise("paragraph")
    rows = blocks(spark, sf_dir).withColumn("role", role).where("text <> '' or role <> 'paragraph'")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select(*KEYS, E.explain_cache_key(name, F.col("text"), F.lit("en"), F.col("role"), F.col("page"), box).alias("key"))


@check("clean_lines", K.sql("select doc_id, page, seq, ln, text, x0, y0, x1, y1 from lines"))
def clean_lines(spark, sf_dir):
    from folioframe.sources.layout import flat_lines

    return flat_lines(blocks(spark, sf_dir)).drop("part")


@check("unwrapped_layout", K.sql("select doc_id, page, seq, part, block_type, x0, y0, x1, y1 from blk"))
def unwrapped_layout(spark, sf_dir):
    from folioframe.sources.layout import unwrap_groups

    return unwrap_groups(sample_layout.layout_blocks(documents(spark, sf_dir))).select(*KEYS, "part", "block_type", "x0", "y0", "x1", "y1")


_MATH = f"""math as (select *, row_number() over (partition by doc_id, page order by seq, j) - 1 ord from alll where block_type = 'TextInlineMath' and not removed),
mcount as (select doc_id, page, count(*) n from math group by all),
given as (select doc_id, page, ord, case when (doc_id + ord) % 7 = 0 then ' ' else 'rec ' || t end text from
  (select m.doc_id, m.page, m.ord, r.t from math m join rawt r using (doc_id, page, seq, j)) where not (page % 5 = 0 and ord = 0)),
gcount as (select doc_id, page, count(*) n from given group by all)"""


@check("inline_math_override", K.sql(f"""select doc_id, page, seq, (row_number() over (partition by doc_id, page, seq order by j) - 1)::int ln, text from (
  select m.doc_id, m.page, m.seq, m.j, {K.norm("case when gc.n = mc.n and " + K.strip("g.text") + " <> '' then " + K.strip("g.text") + " else m.text end")} text
  from math m join mcount mc using (doc_id, page) left join gcount gc using (doc_id, page) left join given g on g.doc_id = m.doc_id and g.page = m.page and g.ord = m.ord)
  where text <> ''""", _MATH))
def inline_math_override(spark, sf_dir):
    from folioframe.sources.layout import flat_lines, read_layout

    docs = documents(spark, sf_dir)
    rows = read_layout(sample_layout.layout_blocks(docs), sample_layout.recognized_lines(docs))
    return flat_lines(rows.where("block_type = 'TextInlineMath'")).select(*KEYS, "ln", "text")


def sentences_sql(source: str) -> str:
    """Sentences of ``source`` (doc_id, page, seq, text) with offsets: marks boundaries, then cuts there."""
    mark = "regexp_replace(regexp_replace(text, {p}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), {p}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')".format(
        p=K.q(rf"([.!?…])({K.S}+)([A-ZÁÉÍÓÚÑ¿¡\"(])"))
    return f"""cut as (select doc_id, page, seq, string_split({mark}, chr(1)) ps from {source}),
      cut2 as (select doc_id, page, seq, unnest(ps) p, generate_subscripts(ps, 1) k from cut),
      cut3 as (select *, case when k > 1 then split_part(p, chr(2), 2) else p end body, case when k > 1 then length(split_part(p, chr(2), 1)) else 0 end gap from cut2),
      cut4 as (select *, sum(gap + length(body)) over (partition by doc_id, page, seq order by k) stop0 from cut3),
      sents as (select doc_id, page, seq, (row_number() over (partition by doc_id, page, seq order by k) - 1)::int k, {K.lstrip('body')} text,
        (stop0 - length({K.lstrip('body')}))::int start, stop0::int stop from cut4 where {K.lstrip('body')} <> '')"""


@check("split_sentences", K.sql("select doc_id, page, seq, k, text, start, stop from sents", sentences_sql("(select * from blk where text <> '')")))
def split_sentences(spark, sf_dir):
    spans = S.sentence_spans("text")
    return blocks(spark, sf_dir).where("text <> ''").select(*KEYS, F.posexplode(spans).alias("k", "s")).select(*KEYS, "k", "s.text", "s.start", "s.stop")


LINE_SPANS = """lspan as (select *, (coalesce(sum(length(text)+1) over (partition by doc_id, page, seq order by ln rows between unbounded preceding and 1 preceding), 0))::int a from lines)"""
SENT_BOXES = """sbox as (select s.doc_id, s.page, s.seq, s.k, l.ln, s.text, round(l.x0 + (greatest(s.start, l.a) - l.a) * ((l.x1-l.x0)/length(l.text)), 2) x0, l.y0,
   round(l.x0 + (least(s.stop, l.a + length(l.text)) - l.a) * ((l.x1-l.x0)/length(l.text)), 2) x1, l.y1
   from sents s join lspan l using (doc_id, page, seq) where least(s.stop, l.a + length(l.text)) > greatest(s.start, l.a))"""


@check("sentence_boxes", K.sql("select doc_id, page, seq, (dense_rank() over (partition by doc_id, page, seq order by k) - 1)::int k, text, (row_number() over (partition by doc_id, page, seq, k order by ln) - 1)::int b, x0, y0, x1, y1 from sbox",
                               sentences_sql("(select * from blk where text <> '')"), LINE_SPANS, SENT_BOXES))
def sentence_boxes(spark, sf_dir):
    rows = blocks(spark, sf_dir).where("text <> ''").select(*KEYS, F.posexplode(S.build_sentences()).alias("k", "s"))
    return rows.select(*KEYS, "k", "s.text", F.posexplode("s.boxes").alias("b", "box")).select(*KEYS, "k", "text", "b", "box.*")


@check("phrase_boxes", K.sql("""select doc_id, page, seq, k0 k, (row_number() over (partition by doc_id, page, seq, k0 order by b) - 1)::int b, x0 + (s - lo) / (hi - lo) * w px0, y0, x0 + (e - lo) / (hi - lo) * w px1, y1 from (
   select *, greatest(pos, lo) s, least(pos + length(term), hi) e from (
   select *, cum / tot * n lo, (cum + w) / tot * n hi from (
   select doc_id, page, seq, k0, term, pos::double pos, b, x0, y0, x1, y1, greatest(0.0, x1-x0) w, n, sum(greatest(0.0, x1-x0)) over p tot,
     coalesce(sum(greatest(0.0, x1-x0)) over (p order by b rows between unbounded preceding and 1 preceding), 0.0) cum from (
   select f.doc_id, f.page, f.seq, k0, term, instr(lower(f.text), lower(term)) - 1 pos, length(f.text) n, (row_number() over (partition by f.doc_id, f.page, f.seq, k order by ln) - 1)::int b, x0, y0, x1, y1
   from (select doc_id, page, seq, text, k, (row_number() over (partition by doc_id, page, seq order by k) - 1)::int k0, regexp_extract(text, '[^ ]+ [^ ]+ ([^ ]+)', 1) term from sents) f
   join sbox using (doc_id, page, seq, k) where term <> '') window p as (partition by doc_id, page, seq, k0)))) where e > s""",
   sentences_sql("(select * from blk where text <> '')"), LINE_SPANS, SENT_BOXES))
def phrase_boxes(spark, sf_dir):
    flat = blocks(spark, sf_dir).where("text <> ''").select(*KEYS, F.posexplode(S.build_sentences()).alias("k", "sentence"))
    rows = flat.withColumn(
        "term", F.regexp_extract("sentence.text", "[^ ]+ [^ ]+ ([^ ]+)", 1)).where("term <> ''")
    return E.concept_boxes(rows).select(*KEYS, "k", F.posexplode("term_boxes").alias("b", "x")).select(
        *KEYS, "k", "b", F.col("x.x0").alias("px0"), F.col("x.y0").alias("y0"), F.col("x.x1").alias("px1"), F.col("x.y1").alias("y1"))


@check("numbered_sentences", K.sql("select doc_id, page, seq, string_agg('[S' || k || '] ' || text, chr(10) order by k) numbered from sents group by all",
                                   sentences_sql("(select * from blk where text <> '')")))
def numbered_sentences(spark, sf_dir):
    texts = F.transform(S.sentence_spans("text"), lambda s: s["text"])
    return blocks(spark, sf_dir).where("text <> ''").select(*KEYS, E.number_sentences(texts).alias("numbered"))


@check("request_prompts", K.sql("""select doc_id, page, seq, 'Map:' || chr(10) || m || chr(10) || chr(10) || 'Paragraph:' || chr(10) || numbered ||
    case when notes then chr(10) || chr(10) || 'Footnotes:' || chr(10) || '[Footnote] † note ' || doc_id else '' end prompt,
    chr(10) || chr(10) || 'Language of all values but verbatim quotes: ' || (['Spanish','English','English'])[doc_id % 3 + 1] || '.' rule,
    'Map:' || chr(10) || m || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Selection:' || chr(10) || sel concept_prompt from (
    select doc_id, page, seq, '{"core_methodology":"m' || doc_id || '"}' m, string_agg('[S' || k || '] ' || text, chr(10) order by k) numbered,
    string_agg(text, chr(10) order by k) context, first(text order by k) sel, doc_id % 2 = 0 notes from sents group by doc_id, page, seq)""",
    sentences_sql("(select * from blk where text <> '')")))
def request_prompts(spark, sf_dir):
    texts = F.transform(S.sentence_spans("text"), lambda s: s["text"])
    d = F.col("doc_id").cast("string")
    map_json = F.to_json(F.struct(F.concat(F.lit("m"), d).alias("core_methodology")))
    notes = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("† note "), d))).otherwise(F.array().cast("array<string>"))
    codes = F.array(F.lit("es"), F.lit("en"), F.lit("fr"))
    rows = blocks(spark, sf_dir).where("text <> ''").withColumn("texts", texts)
    return rows.select(*KEYS, E.explain_prompt(map_json, F.col("texts"), notes).alias("prompt"), E.language_rule(F.get(codes, (F.col("doc_id") % 3).cast("int"))).alias("rule"),
                       E.concept_prompt(map_json, F.col("texts"), F.get("texts", F.lit(0))).alias("concept_prompt"))


@check("bare_latex", """select conv_id, turn, case when regexp_matches(s, '[$]|\\\\\\(|\\\\\\[') then s when regexp_matches(s, '\\\\[a-zA-Z]') then '$$' || s || '$$' else s end wrapped
  from (select conv_id, turn, case when turn % 3 = 0 then text || ' \\alpha' when turn % 3 = 1 then text || ' $x$' else text end s from conversations)""")
def bare_latex(spark, sf_dir):
    t = F.col("turn")
    s = F.when(t % 3 == 0, F.concat("text", F.lit(" \\alpha"))).when(t % 3 == 1, F.concat("text", F.lit(" $x$"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrap_bare_latex(s).alias("wrapped"))


# The pattern of the pieces without its looks ahead, which matter for empty formulas only; the texts have none.
_PIECES = r"(?s)\\\$|\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$[^$]+\$|[^\\$]+|."


@check("math_tokens", f"""with s as (select conv_id, turn, text || case when turn % 2 = 0 then ' costs \\$5 and $x+1$ or \\(y\\) so $$z$$ and \\[w\\]' else '' end s from conversations where text is not null),
  r as (select conv_id, turn, s, regexp_extract_all(s, '{_PIECES}') l from s),
  p as (select conv_id, turn, s, generate_subscripts(l, 1) i, unnest(l) t from r),
  q as (select *, length(t) > 2 and (t[1] = '$' or t[1:2] in ('\\[', '\\(')) and (t[1:2] <> '$$' or length(t) > 4) math from p),
  c as (select *, case when not math then 0 when t[1:2] = '$$' or t[1] = '\\' then 2 else 1 end cut from q),
  f as (select *, math or lag(math, 1, true) over (partition by conv_id, turn, s order by i) fresh from c),
  g as (select *, sum(fresh::int) over (partition by conv_id, turn, s order by i) - 1 k from f)
  select conv_id, turn, k::int k, case when math then 'math' else 'text' end "type", string_agg(case when math then t[cut + 1 : length(t) - cut] when t = '\\$' then '$' else t end, '' order by i) "value",
    bool_or(math and (t[1:2] = '$$' or t[1:2] = '\\[')) display from g group by conv_id, turn, s, k, math""")
def math_tokens(spark, sf_dir):
    """Math and text pieces of conversation turns, half of which get formulas put in."""
    t = F.col("turn")
    s = F.when(t % 2 == 0, F.concat("text", F.lit(" costs \\$5 and $x+1$ or \\(y\\) so $$z$$ and \\[w\\]"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(E.tokenize_math(s)).alias("k", "t"))
    return rows.select("conv_id", "turn", "k", "t.type", "t.value", "t.display")


@check("model_errors", """select event_id, status, case when code = 'ECONNABORTED' then 'timeout' when status is null then 'no_connection' when status = 400 then 'bad_request'
   when status = 502 then case when d like '%truncated%' or d like '%max_tokens%' then 'truncated' when d like '%invalid json%' then 'invalid_json'
     when d like '%429%' or d like '%rate%' or d like '%quota%' then 'rate_limit' when d like '%empty response%' then 'empty' else 'transient' end
   when status >= 500 then 'server' else 'unexpected' end kind,
   (status is null and code <> 'ECONNABORTED') or coalesce(status in (429,502,503,504), false) retryable,
   case when attempt < 3 then (1000 * 2 ** (attempt-1))::int end delay_ms
   from (select event_id, case when event_id % 8 = 0 then 'ECONNABORTED' else '' end code, ([null,400,502,502,502,502,500,404,429,503,null])[(event_id % 11) + 1]::int status,
     lower((['Truncated by MAX_TOKENS','Invalid JSON','quota exceeded','Empty response','other'])[(event_id % 5) + 1]) d, (event_id % 3 + 1)::int attempt from events)""")
def model_errors(spark, sf_dir):
    e = F.col("event_id")
    statuses = F.array(*[F.lit(s).cast("int") for s in (None, 400, 502, 502, 502, 502, 500, 404, 429, 503, None)])
    details = F.array(*[F.lit(s) for s in ("Truncated by MAX_TOKENS", "Invalid JSON", "quota exceeded", "Empty response", "other")])
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 8 == 0, "ECONNABORTED").otherwise("").alias("code"), F.get(statuses, (e % 11).cast("int")).alias("status"),
        F.get(details, (e % 5).cast("int")).alias("detail"), (e % 3 + 1).cast("int").alias("attempt"))
    return rows.select("event_id", "status", J.classify_model_error().alias("kind"), J.is_retryable().alias("retryable"), J.retry_delay_ms().alias("delay_ms"))


@check("parsed_answers", """select event_id, case when body = '' then 'Empty response (finish_reason=' || finish || ')' when string_split(finish, '.')[-1] not in ('STOP','1')
    then 'Response truncated (finish_reason=' || finish || ')' when not json_valid(body) then 'Invalid JSON (finish_reason=' || finish || ')'
    when body not like '{%' or (body->>'$.k') is null then 'Invalid answer (finish_reason=' || finish || ')' end error,
    case when body <> '' and string_split(finish, '.')[-1] in ('STOP','1') and json_valid(body) and body like '{%' then (body->>'$.k')::int end k
  from (select event_id, case event_id % 12 when 2 then '{''k'': 1}' when 3 then '{}' when 6 then '[1]' when 7 then '{"a":1}' else case event_id % 4 when 0 then '' when 1 then props || '}' else props end end body, (['STOP','FinishReason.STOP','MAX_TOKENS','1'])[(event_id % 5) % 4 + 1] finish from events)""")
def parsed_answers(spark, sf_dir):
    e = F.col("event_id")
    odd = {2: "{'k': 1}", 3: "{}", 6: "[1]", 7: '{"a":1}'}
    body = F.coalesce(*[F.when(e % 12 == k, F.lit(b)) for k, b in odd.items()]).alias("odd")
    body = F.when(body.isNotNull(), body).when(e % 4 == 0, "").when(e % 4 == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    finish = F.get(F.array(*[F.lit(s) for s in ("STOP", "FinishReason.STOP", "MAX_TOKENS", "1")]), (e % 5 % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"), finish.alias("finish"))
    return E.parse_model_json(rows, "struct<k:int>").select("event_id", "error", "parsed.k")
