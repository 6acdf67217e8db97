"""Licence scans by sentence rules, in built-in functions only.

A text is cut into pieces; one piece in normal form (lower case, words only), or several of one paragraph that no full stop parts,
that make a known licence sentence become its identifier. So line ends, comment prefixes, ; and : inside a sentence hide nothing.
A licence is an ordered sequence of identifiers; it is found
where a document's known sentences contain the sequence, one right after the other. Of findings that
lie inside one another, the longest counts. All of it happens inside a row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normal form, by identifier.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-licensed-notice": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-language": "see the license for the specific language governing permissions and limitations under the license",
    "gpl2-licensed": "this work is licensed under the gnu general public license version 2",
    "gpl3-licensed": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-licensed": "licensed under the gnu lesser general public license version 3",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}
# The licence of each ordered sequence of sentences.
RULES = [
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-title-short", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-licensed-notice"]),
    ("Apache-2.0", ["apache-licensed-notice", "apache-compliance", "apache-copy", "apache-as-is", "apache-language"]),
    ("GPL-2.0-only", ["gpl2-licensed"]),
    ("GPL-3.0-only", ["gpl3-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("LGPL-3.0-only", ["lgpl-licensed"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("proprietary", ["rights"]),
]
IDS = {name: i + 1 for i, name in enumerate(SENTENCES)}

# Other wordings of known sentences, in normal form. The SQL does not have them.
_WORKS = ("project", "software", "work", "program", "package", "library", "module", "code", "source code", "repository", "file", "document", "content")
_OPENINGS = {"mit-licensed": SENTENCES["mit-licensed"], "mit-released": SENTENCES["mit-released"], "apache-licensed": SENTENCES["apache-licensed"],
             "gpl2-licensed": "licensed under the gnu general public license version 2", "gpl3-licensed": "licensed under the gnu general public license version 3",
             "lgpl-licensed": SENTENCES["lgpl-licensed"], "cc-by": SENTENCES["cc-by"], "cc-by-sa": SENTENCES["cc-by-sa"], "cc-by-nc": SENTENCES["cc-by-nc"]}
VARIANTS = {f"{the} {work} is {words}": name for name, words in _OPENINGS.items() for the in ("this", "the") for work in _WORKS}
VARIANTS |= {words: name for name, words in _OPENINGS.items()} | {
    "distributed under the mit license": "mit-released",
    "available under the mit license": "mit-released",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "mpl-subject",
}
VARIANTS = {words: name for words, name in VARIANTS.items() if words not in SENTENCES.values()}

# A piece ends at . ! ? ; : before white space, and at an empty or list-item line; a plain line end ends one too, unless the
# next line goes on in lower case.
BREAK = r"[.!?;:]+[)\"]*\s+|\s*\n\s*\n\s*|\s*\n\s*(?=[^a-z\s])"


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower case, runs of letters and digits joined by one space."""
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "), r"\blicence", "license"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), BREAK), plain)


# After these words a full stop ends no sentence.
ABBREVIATED = "(?:^| )(?:v|ver|inc|ltd|corp|co)$"


def _goes_on(text: Column, pieces: Column) -> Column:
    """For each piece but the last: whether its sentence may go on in the next one (no full stop, and no empty line, between them)."""
    def inside(cut: Column, i: Column) -> Column:
        stop = cut.rlike("[.!?]") & ~(cut.startswith(".") & F.get(pieces, i).rlike(ABBREVIATED))
        return (F.get(pieces, i) != "") & (F.get(pieces, i + 1) != "") & ~cut.rlike(r"\n\s*\n") & ~stop

    return F.transform(F.regexp_extract_all(text, F.lit(BREAK), F.lit(0)), inside)


# Each known sentence has one of these words, so a text without any holds none.
ANCHORS = "licen[sc]e|permission|warrant|liable|redistribution|contributors|domain|reserved"


def _may_hold(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(ANCHORS), F.lit(False))


def _hits(pieces: Column, on: Column) -> Column:
    """The known sentences of a text in order: place and end (its first and last piece, from 0) and id. The longest counts."""
    listed = {SENTENCES[n]: i for n, i in IDS.items()} | {words: IDS[n] for words, n in VARIANTS.items()}
    known, ids = F.array(*[F.lit(s) for s in listed]), F.array(*[F.lit(i) for i in listed.values()])
    most, first = max(len(s.split()) for s in listed), sorted({s.split()[0] for s in listed})

    def joined(s: Column, i: Column) -> Column:
        """How many pieces from here make the longest known sentence of more than one; no known sentence has more than ``most`` words."""
        def whole(m: Column) -> Column:
            return F.forall(F.slice(on, i + 1, m - 1), lambda x: x) & F.array_contains(known, F.concat_ws(" ", F.slice(pieces, i + 1, m)))

        begins = F.coalesce(F.get(on, i), F.lit(False)) & F.substring_index(s, " ", 1).isin(first) & F.exists(known, lambda k: k.startswith(F.concat(s, F.lit(" "))))
        return F.when(begins, F.array_max(F.filter(F.sequence(F.lit(2), F.least(F.lit(most), F.size(pieces) - i)), whole)))

    counted = F.transform(pieces, lambda s, i: F.struct(i.alias("place"), F.coalesce(joined(s, i), F.lit(1)).alias("n")))
    placed = F.transform(counted, lambda c: F.struct(
        c["place"].alias("place"), (c["place"] + c["n"] - 1).alias("end"),
        F.array_position(known, F.when(c["n"] == 1, F.get(pieces, c["place"])).otherwise(F.concat_ws(" ", F.slice(pieces, c["place"] + 1, c["n"])))).cast("int").alias("at")))
    return F.transform(F.filter(placed, lambda h: h["at"] > 0), lambda h: F.struct(h["place"].alias("place"), h["end"].alias("end"), F.element_at(ids, h["at"]).alias("id")))


def license_findings(docs: DataFrame, gap: int = 2) -> DataFrame:
    """Licences in the whole texts of ``docs`` (doc_id, text; further columns are ignored), a row per finding.

    Returns doc_id, license, rule (its number, from 1), first and last (its first and last piece, as ``BREAK`` cuts them, from 0).
    Between two sentences of a rule at most ``gap`` unknown ones may stand, and no other known one; empty lines do not count. A finding
    inside a longer one is dropped. A null or empty text has no finding; repeated rows have their findings each.
    An empty table gives an empty result.
    """
    cut = docs.where(_may_hold(F.col("text"))).select("doc_id", "text", sentences(F.col("text")).alias("pieces"))
    cut = cut.select("doc_id", "pieces", _goes_on(F.col("text"), F.col("pieces")).alias("on"))
    # No filter on these columns: Spark may push it below them and work them out anew at each place that names them.
    held = cut.select("doc_id", "pieces", "on", _hits(F.col("pieces"), F.col("on")).alias("all"))
    inside = lambda h: F.exists("all", lambda g: (g["place"] <= h["place"]) & (g["end"] >= h["end"]) & (g["end"] - g["place"] > h["end"] - h["place"]))
    held = held.select("doc_id", "pieces", "on", F.filter("all", lambda h: ~inside(h)).alias("hits"))

    def between(a: Column, b: Column) -> Column:
        """Unknown sentences between two known ones."""
        starts = lambda k: (F.get("pieces", k) != "") & ((k == a["end"] + 1) | ~F.get("on", k - 1))
        return F.when(b["place"] - a["end"] > 1, F.size(F.filter(F.sequence(a["end"] + 1, b["place"] - 1), starts))).otherwise(0)

    def found(rule: int, wanted: list[str]):
        size, ids = len(wanted), F.array(*[F.lit(IDS[w]) for w in wanted])

        def at(i: Column) -> Column:
            part = F.slice("hits", i, size)
            close = F.aggregate(F.sequence(F.lit(2), F.lit(size)), F.lit(True), lambda ok, j: ok & (between(F.element_at(part, j - 1), F.element_at(part, j)) <= gap)) if size > 1 else F.lit(True)
            good = (F.transform(part, lambda h: h["id"]) == ids) & close
            return F.when(good, F.struct(F.lit(rule).alias("rule"), F.element_at(part, 1)["place"].alias("first"), F.element_at(part, -1)["end"].alias("last")))

        starts = F.when(F.size("hits") >= size, F.sequence(F.lit(1), F.size("hits") - (size - 1)))
        return F.coalesce(F.filter(F.transform(starts, at), lambda x: x.isNotNull()), F.array().cast("array<struct<rule:int,first:int,last:int>>"))

    every = F.concat(*[found(i + 1, wanted) for i, (_, wanted) in enumerate(RULES)])
    # Only findings of several sentences can hold others.
    longest = F.filter("found", lambda x: ~F.exists("wide", lambda y: (y["first"] <= x["first"]) & (y["last"] >= x["last"]) & (y["last"] - y["first"] > x["last"] - x["first"])))
    names = F.array(*[F.lit(license) for license, _ in RULES])
    rows = held.withColumn("found", every).withColumn("wide", F.filter("found", lambda x: x["last"] > x["first"])).select("doc_id", F.explode(longest).alias("x"))
    return rows.select("doc_id", F.element_at(names, F.col("x.rule")).alias("license"), F.col("x.rule").alias("rule"), F.col("x.first").alias("first"), F.col("x.last").alias("last"))


def _values(rows) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)


def findings_sql(gap: int = 2) -> str:
    """The same in DuckDB for sentences of one piece in their first wording: sentences and rules as tables, joins and grouping."""
    steps = [(r + 1, license, k + 1, len(ids), IDS[s]) for r, (license, ids) in enumerate(RULES) for k, s in enumerate(ids)]
    return f"""
with known(sentence, id) as (values {_values([(s, IDS[n]) for n, s in SENTENCES.items()])}),
steps("rule", license, step, size, id) as (values {_values(steps)}),
cut as (select row_number() over () row, doc_id, regexp_split_to_array(regexp_replace(text, '{BREAK.replace("(?=[^a-z" + chr(92) + "s])", "([^a-z" + chr(92) + "s])")}', chr(1) || '\\1', 'g'), chr(1)) parts from documents where text is not null),
each as (select row, doc_id, unnest(parts) part, generate_subscripts(parts, 1) - 1 place from cut),
plain as (select row, doc_id, place, trim(replace(' ' || trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' licence', ' license')) sentence from each),
hits as (select row, doc_id, place, id, row_number() over (partition by row order by place) n from plain join known using (sentence)),
m as (select a.row, a.doc_id, s."rule", s.license, s.size, a.n - s.step n0, min(a.place) "first", max(a.place) "last", count(*) c,
   max(a.place - coalesce(b.place, a.place)) filter (where s.step > 1) far
   from hits a join steps s using (id) left join hits b on a.row = b.row and b.n = a.n - 1 group by all having count(*) = s.size),
f as (select * from m where coalesce(far, 0) <= {gap + 1})
select doc_id, license, "rule"::int "rule", "first"::int "first", "last"::int "last" from f x where not exists (select 1 from f y where y.row = x.row
   and y."first" <= x."first" and y."last" >= x."last" and y."last" - y."first" > x."last" - x."first")
"""
