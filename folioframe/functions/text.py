"""Predicates and scalar functions over block text, as native Column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V

_FN = "[" + re.escape(V.FOOTNOTE_SYMBOLS).replace("#", "\\#") + "]"
_STRIP = "[" + re.escape(V.NAME_STRIP_CHARS) + "]"
_END_TRIM = r"[ \t\n\r\"'”’»)\]}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def lstrip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+", "")


def rstrip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)\s+$", "")


def normalize_text(c) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(r"(?U)\S+"))


# -- section names ---------------------------------------------------------------------------------------


def is_stop_header(c) -> Column:
    t = strip(c)
    alone = t.rlike(rf"(?iU)^(?:\d+[.\s]+)?{V.STOP_NAMES}\b[\s:.]*$")
    glued = t.rlike(rf"(?iU)^(?:(?:\d+|[ivxlcdm]+)[.\s]+)?{V.STOP_NAMES}\s*[.:—]\s+\S")
    return alone | glued


def is_skip_section(c) -> Column:
    return strip(c).rlike(rf"(?iU)^{V.SKIP_NAMES}\b[\s:.]*$")


def is_skip_section_inline(c) -> Column:
    return strip(c).rlike(rf"(?iU)^{V.SKIP_NAMES}\s*[:.–—]\s*\S")


def is_body_section_name(c) -> Column:
    return strip(c).rlike(rf"(?iU)^(?:\d+(?:\.\d+)*[.\s]+)*{V.BODY_NAMES}\b")


def is_metadata_block(c) -> Column:
    # The possessive group pins the opener, so what follows it can be judged in the same pattern.
    return _col(c).rlike(rf"(?iU)^(?>\s*{V.METADATA_NAMES}\b)\s*(?:$|[:：.\-–—])")


def is_abstract_header(c) -> Column:
    return strip(c).rlike(r"(?iU)^(?:\d+[.\s]*)?(?:abstract|resumen)\b")


# -- noise -----------------------------------------------------------------------------------------------


def is_hard_noise(c) -> Column:
    return _col(c).rlike(f"(?iU){V.HARD_NOISE}")


def is_license_noise(c) -> Column:
    return _col(c).rlike(f"(?iU){V.LICENSE_NOISE}")


def has_affiliation(c) -> Column:
    return _col(c).rlike(f"(?iU){V.SOFT_NOISE}")


def is_soft_noise(c) -> Column:
    return (word_count(c) <= 60) & has_affiliation(c)


def _occurrences(c, ch: str) -> Column:
    return F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(ch), F.lit("")))


def looks_like_author_line(c) -> Column:
    n = word_count(c)
    proper = F.regexp_count(_col(c), F.lit(rf"(?U)(?<!\S){V.PROPER_NOUN}(?!\S)"))
    return n.between(1, 18) & (_occurrences(c, ".") <= 2) & (_occurrences(c, ";") <= 2) & (
        proper >= F.greatest(F.lit(2), n - 4)
    )


def proper_noun_count(c) -> Column:
    """Words that are a capitalised name once affixed digits, marks and brackets are taken off."""
    return F.regexp_count(_col(c), F.lit(rf"(?U)(?<!\S){_STRIP}*{V.PROPER_NOUN}{_STRIP}*(?!\S)"))


def is_dense_name_list(c) -> Column:
    n = word_count(c)
    return (n >= 4) & (proper_noun_count(c) >= 0.6 * n)


def is_contact_block(c) -> Column:
    t = strip(c)
    named = proper_noun_count(t) >= 0.4 * word_count(t)
    return t.rlike(f"(?U){V.EMAIL}") | (has_affiliation(t) & named & ~t.rlike(r"[.?!…]$") & (t != ""))


# -- continuation and labels -----------------------------------------------------------------------------


def starts_lowercase(prev, new) -> Column:
    return _col(new).rlike(r"(?U)^\s*[\p{IsLowercase}&&\p{L}]") & _col(prev).rlike(r"(?U)\S")


def ends_unterminated(c) -> Column:
    return _col(c).rlike(rf"(?s)[^.!?… \t\n\r\"'”’»)\]}}]{_END_TRIM}*\z")


def is_bullet(c) -> Column:
    return _col(c).rlike(rf"(?iU)^\s*(?:{V.BULLET})\s+\S")


def is_caption_like(c) -> Column:
    return _col(c).rlike(
        rf"(?iU)^\s*(?>{V.CAPTION_NAMES}\s*(?:[IVXLCDM]+|\d+)?\b)\s*"
        r"(?-i:$|[.:—–]|\p{IsUppercase}|[\p{Nd}¹²³⁰⁴-⁹])"
    )


def is_source_line(c) -> Column:
    return _col(c).rlike(r"(?iU)^(?:source|fuente)\s*:")


def is_source_attribution(role, c) -> Column:
    return (_col(role) == "paragraph") & is_source_line(lstrip(c))


def is_subfigure_caption(c) -> Column:
    return strip(c).rlike(rf"(?U)^(?:{V.PANEL_LABEL})")


def is_table_label(role, c) -> Column:
    return (
        _col(role).isin("paragraph", "caption", "section_header")
        & _col(c).rlike(r"(?iU)^\s*(?:table|tabla)\b")
        & is_caption_like(c)
    )


def is_table_note(role, c) -> Column:
    return _col(role).isin("paragraph", "caption") & _col(c).rlike(rf"(?iU)^\s*(?:{V.TABLE_NOTE})")


def is_algorithm_header(c) -> Column:
    return _col(c).rlike(rf"(?iU)^\s*{V.ALGORITHM_HEADER}")


def is_algorithm_label_only(c) -> Column:
    return _col(c).rlike(rf"(?iU)^\s*{V.ALGORITHM_LABEL_ONLY}")


def is_caption_block(role, c) -> Column:
    return (_col(role) == "caption") | ((_col(role) == "paragraph") & is_caption_like(c))


def leading_footnote_symbol(c) -> Column:
    return F.regexp_extract(_col(c), rf"(?U)^\s*({_FN}+)", 1)


def strong_footnote_prefix(c) -> Column:
    return _col(c).rlike(
        rf"(?U)^\s*(?=[{V.STRONG_FOOTNOTE_SYMBOLS}]|{_FN}{{2}}){_FN}++(?![\p{{Nd}}¹²³⁰⁴-⁹])"
    )


def footnote_symbols_of(c) -> Column:
    """The footnote symbols of a text, everything else taken out."""
    return F.regexp_replace(_col(c), _FN.replace("[", "[^", 1), "")


def has_footnote_symbol(c) -> Column:
    return _col(c).rlike(_FN)


# -- block types and roles -------------------------------------------------------------------------------


def block_bucket(t) -> Column:
    t = _col(t)
    return (
        F.when(t.isin(V.BODY_TEXT_TYPES), "body_text")
        .when(t.isin(V.TEXT_TYPES), "text")
        .when(t.isin(V.IMAGE_TYPES), "image")
        .when(t.isin(V.DROP_TYPES), "drop")
        .when(t == "SectionHeader", "header")
        .otherwise("other")
    )


def text_role(t) -> Column:
    t = _col(t)
    return (
        F.when(t == "Caption", "caption").when(t == "Equation", "equation").when(t == "Code", "code")
        .otherwise("paragraph")
    )


def image_role(t) -> Column:
    return F.when(_col(t) == "Table", "table").otherwise("figure")


def resolve_merged_role(roles) -> Column:
    r = _col(roles)
    return (
        F.when(F.array_contains(r, "table"), "table").when(F.array_contains(r, "figure"), "figure")
        .when(F.array_contains(r, "algorithm"), "algorithm").otherwise("paragraph")
    )


def explainable(role, n_sentences) -> Column:
    return (_col(role) == "paragraph") & (_col(n_sentences) > 0)


def is_split_boundary(prev, nxt) -> Column:
    prev, nxt = _col(prev), _col(nxt)
    return ~prev.rlike(r"[:;](?U:\s*)$") & (
        ~prev.rlike(V.MERGED_SENTENCE_END) | ~nxt.rlike(V.MERGED_SENTENCE_START)
    )


def language_name(code) -> Column:
    names = F.create_map(*[F.lit(x) for kv in V.LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.coalesce(_col(code), F.lit(V.DEFAULT_LANGUAGE))),
                      F.lit(V.FALLBACK_LANGUAGE_NAME))


# -- scalar text functions -------------------------------------------------------------------------------


def strip_math_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def equation_latex(html) -> Column:
    return strip(strip_math_tags(F.coalesce(_col(html), F.lit(""))))


def join_hyphen(prev, nxt) -> Column:
    p, n = rstrip(prev), lstrip(nxt)
    return F.when(p.rlike("[-—¬]$"), F.concat(F.regexp_replace(p, "[-—¬]$", ""), n)).otherwise(
        F.concat_ws(" ", p, n)
    )


def algorithm_caption(header, next_text, next_role) -> Column:
    line = strip(F.split(lstrip(header), "\n", 2)[0])
    title = strip(F.split(F.coalesce(_col(next_text), F.lit("")), "\n", 2)[0])
    takes_title = (
        _col(next_role).isin("paragraph", "caption", "code") & is_algorithm_label_only(line) & (title != "")
        & (word_count(title) <= V.ALGORITHM_TITLE_WORDS) & ~is_algorithm_header(title)
    )
    sep = F.when(line.rlike(r"[:.\-—]$"), "").otherwise(":")
    return F.when(takes_title, F.concat(line, sep, F.lit(" "), title)).otherwise(line)


def normalize_for_match(c) -> Column:
    """Lower case, no soft hyphens, no hyphen with the spaces after it, single spaces."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = F.regexp_replace(t, r"(?U)-\s*", "")
    t = F.replace(t, F.lit("\u00ad"), F.lit(""))
    return F.regexp_replace(t, r"(?U)\s+", " ")


def significant_words(c) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)[^a-z0-9_áéíóúüñ\s]", " ")
    words = F.split(t, r"(?U)\s+")
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def round_half_up(c) -> Column:
    return F.floor(_col(c) + 0.5)


def wrap_bare_latex(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(r"[$]|\\\(|\\\["), c).when(c.rlike(r"\\[a-zA-Z]"), F.concat(F.lit("$$"), c, F.lit("$$"))).otherwise(c)
