"""Packing, sharding, exact dedup and licence scans against direct versions."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import exact_dedup as X
from folioframe.llm import licenses as L
from folioframe.llm import packing as P
from folioframe.llm import sharding as S


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# Packing

@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_have_the_least_padding(counts, buckets):
    def padding(ends):
        return sum(n * (min(e for e in ends if e >= length) - length) for length, n in counts.items())

    ends = P.boundaries(counts, buckets)
    lengths = sorted(counts)
    best = min(padding([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], k))
    assert ends == sorted(set(ends)) and len(ends) <= buckets and padding(ends) == best


def test_pack_keeps_every_token_once(odd_docs):
    rows = P.pack(odd_docs, context=100, buckets=4, budget=400).collect()
    want = Counter((d, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))) for d, t in texts(odd_docs))
    by_doc = Counter()
    for d, n in want.elements():
        by_doc[d] += n
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == by_doc
    batches = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["padded"] <= 100
            batches[r["bucket"], r["batch"]].append(r)
        else:
            assert r["bucket"] is r["batch"] is r["slot"] is None
    numbers = defaultdict(set)
    for (bucket, batch), held in batches.items():
        numbers[bucket].add(batch)
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert len(held) * held[0]["padded"] <= 400 or len(held) == 1
    assert all(n == set(range(len(n))) for n in numbers.values())


def test_pack_nothing(no_docs):
    assert P.pack(no_docs).count() == 0


# Sharding

def test_shards_are_even_and_groups_stay_together(llm):
    # A group of half of all rows, pairs, and single texts.
    rows = [(i, "hot") for i in range(200)] + [(200 + i, f"pair {i // 2}") for i in range(80)] + [(300 + i, f"one {i}") for i in range(125)]
    out = S.shard_documents(llm.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 405 and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for j in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(sizes[j]))
    text = dict(rows)
    where = defaultdict(Counter)
    for r in out:
        where[text[r["doc_id"]]][r["shard"]] += 1
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]]) + 1 and r["law"] == "rows" and r["grown_shard"] is None
    # Pairs within a shard: 10,012 of the 40,000 at best (four shards), 5,000 by chance (eight).
    assert sum(n * n for n in where["hot"].values()) >= 8000
    assert sum(len(c) > 1 for t, c in where.items() if t.startswith("pair")) <= 2


def test_all_linked_documents_swap(llm):
    rows = [(i, f"pair {i // 2}") for i in range(160)]
    out = S.shard_documents(llm.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {20}
    where = defaultdict(set)
    for r in out:
        where[r["doc_id"] // 2].add(r["shard"])
    # Full shards leave swaps only, and not every pair finds a counterpart; by chance ten of eighty would be together.
    assert sum(len(s) == 1 for s in where.values()) >= 25


def test_sharding_of_odd_rows(odd_docs, no_docs):
    out = S.shard_documents(odd_docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(odd_docs))
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert S.shard_documents(no_docs).count() == 0


# Exact dedup

def classes(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return Counter((m[3], min(g)[3], len(g)) for g in groups.values() for m in g), len(groups)


def test_exact_classes(odd_docs, no_docs):
    want, n = classes(texts(odd_docs))
    for bits in (64, 2):  # with two bits all hashes collide, and only contents tell chunks apart
        out = X.exact_duplicates(odd_docs, hash_bits=bits).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == want
        kept = [r for r in out if r["kept"]]
        assert len(kept) == n and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert X.exact_duplicates(no_docs).count() == 0


def test_chunks_are_the_text_and_are_shared(llm):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30000))
    rows = [(1, long), (2, "prefix that moves everything" + long), (3, "é" * 5000)]
    out = {r["i"]: r["c"] for r in llm.createDataFrame(rows, "i int, text string").select("i", X.chunks(X.F.col("text")).alias("c")).collect()}
    for i, t in rows:
        assert "".join(out[i]).encode("latin-1").decode() == t
        assert all(256 <= len(c) <= 4096 for c in out[i][:-1])
    assert len(set(out[1]) & set(out[2])) > 0.7 * len(out[1])


def test_keep_rows_keeps_columns_and_one_of_repeated_rows(odd_docs):
    kept = X.keep_rows(odd_docs, X.exact_duplicates(odd_docs).where("kept"))
    assert kept.columns == odd_docs.columns
    assert kept.count() == classes(texts(odd_docs))[1]


# Licences

MIT = ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]


def shown(names):
    return " ".join(L.SENTENCES[n].capitalize() + "." for n in names)


def test_license_rules(llm, odd_docs, no_docs):
    cases = {
        1: ("Text.\n" + shown(MIT), {("MIT", 1, 4)}),
        2: ("The MIT License.\n\n" + shown(MIT) + " More.", {("MIT", 0, 4)}),
        3: (shown(MIT[:1] + MIT[2:]), set()),
        4: (shown(["bsd-grant", "bsd-source", "bsd-binary"]), {("BSD-2-Clause", 0, 2)}),
        5: (shown(["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]), {("BSD-3-Clause", 0, 3)}),
        6: ("Licensed under the Apache Licence, Version 2.0.\nThen text. Released under the MIT License.", {("Apache-2.0", 0, 0), ("MIT", 2, 2)}),
        7: (shown(["gpl-free", "gpl-hope"]) + " Two. Between. " + shown(["gpl-details"]), {("GPL-3.0-or-later", 0, 4)}),
        8: (shown(["gpl-free", "gpl-hope"]) + " Now. Three. Between. " + shown(["gpl-details"]), {("GPL-3.0-or-later", 0, 0)}),
        9: ("They say all rights reserved here.", set()),
        10: ("Permission is hereby granted, free of charge, to any person.", set()),
        11: ("  ALL RIGHTS   RESERVED!", {("proprietary", 0, 0)}),
    }
    out = defaultdict(set)
    for r in L.license_findings(llm.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")).collect():
        out[r["doc_id"]].add((r["license"], r["first"], r["last"]))
    assert {k: out[k] for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert L.license_findings(odd_docs).count() == 0 and L.license_findings(no_docs).count() == 0


def test_license_rules_are_ordered_and_known():
    assert len({tuple(ids) for _, ids in L.RULES}) == len(L.RULES)
    assert all(i in L.SENTENCES for _, ids in L.RULES for i in ids)
    assert all(any(re.search(L.ANCHORS, word) for word in s.split()) for s in L.SENTENCES.values())


MIT_FILE = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC_FILE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
GPL_NOTICE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_wrapped_license_texts_and_comment_headers(llm):
    files = {"MIT": (MIT_FILE, 5), "ISC": (ISC_FILE, 6), "GPL-3.0-or-later": (GPL_NOTICE, 15), "MPL-2.0": (MPL_NOTICE, 17), "Apache-2.0": (APACHE_NOTICE, 11)}
    cases = {}
    for license, (text, rule) in files.items():
        for before in ("", "# ", " * ", "// ", "-- ", "    "):
            body = "".join((before + line).rstrip() + "\n" for line in text.splitlines())
            cases[f"{license} behind {before!r}"] = (body + "import this\n", {(license, rule)})
        cases[f"{license} in one line each"] = ("\n\n".join(" ".join(p.split()) for p in text.split("\n\n")), {(license, rule)})
    cases |= {
        "lead-in": ("About.\n\nThis project is licensed under the MIT Licence.\n", {("MIT", 2)}),
        "wrapped lead-in": ("This software is licensed under the\nApache License, Version 2.0.", {("Apache-2.0", 9)}),
        "full stops part": ("All. Rights. Reserved.", set()),
        "an empty line parts": ("All\n\nRights Reserved.", set()),
        "more before": ("They say all\nRights Reserved.", set()),
        "one sentence lacks": (MIT_FILE.replace("copies or substantial portions", "copies"), set()),
    }
    out = defaultdict(set)
    for r in L.license_findings(llm.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")).collect():
        out[r["doc_id"]].add((r["license"], r["rule"]))
    assert {k: out[k] for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert all(any(re.search(L.ANCHORS, word) for word in s.split()) for s in L.VARIANTS)
