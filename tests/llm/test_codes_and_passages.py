"""Vector codes, benchmark passages and collocations against direct versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import decontamination as D
from folioframe.llm import phrases as P
from folioframe.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<float>, label int"


# Vector codes

@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 40))
def test_active_entries_choose_as_a_full_scan(seed, entries, rows):
    rng = np.random.default_rng(seed)
    x, old = rng.integers(-3, 4, (rows, 3)), rng.integers(-3, 4, (entries, 3))
    code, dist, count = V.assign(x, old)
    assert count == rows * entries
    new = np.where(rng.random(entries)[:, None] < 0.4, rng.integers(-3, 4, (entries, 3)), old)
    moved = (new != old).any(axis=1)
    code, dist, count = V.assign(x, new, code, dist, moved)
    full = ((x[:, None, :] - new[None, :, :]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert count <= rows * entries and (moved.any() or count == 0)


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(256 * x)) for x in r[1]]))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for j in range(books.shape[1]):
                    if (code[p] == j).any():
                        books[p, j] = x[code[p] == j, p].sum(axis=0) // (code[p] == j).sum()
    error = d.min(axis=2).sum(axis=0)
    total = defaultdict(int)
    for r, e in zip(rows, error):
        total[r[2]] += int(e)
    return Counter((r[0], bytes(code[:, i].astype(np.uint8)), int(error[i]), total[r[2]]) for i, r in enumerate(rows))


def test_codes_equal_plain_lloyd(llm):
    rng = random.Random(5)
    rows = [(i * 3 if i % 17 else None, [rng.choice((-0.5, 0.1, 0.25, 0.9)) + rng.random() * (i % 3) for _ in range(8)], rng.choice((None, 1, 2, 3))) for i in range(400)]
    rows += rows[5:40] + [(7, rows[1][1], 4), (7, rows[2][1], 4)]
    bad = [(1, None, 1), (2, [None] * 8, 1), (4, [float("nan")] + [0.0] * 7, 1), (5, [float("inf")] + [0.0] * 7, 2), (8, [], 1), (10, [0.5] * 4, 1), (11, [1e30] + [0.0] * 7, 1)]
    df = llm.createDataFrame(rows + bad, VECTORS).selectExpr("*", "'x' as code", "1 as v", "2 as part", "3 as error", "4 as dist").repartition(7)
    out = V.compress(df, parts=4, entries=16, rounds=3).collect()
    assert Counter((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in out) == plain_codes(rows, 4, 16, 3)
    assert len({r["codebooks_sha256"] for r in out}) == 1
    # Rounds after the first compare less than a full scan would.
    assert sum(r["compared"] for r in out) < len(out) * 4 * 16 * 4


def test_codes_of_few_vectors_none_and_uneven_parts(llm):
    few = V.compress(llm.createDataFrame([(1, [0.5, -0.001], None), (2, [0.5, -0.001], None)], VECTORS), parts=2).collect()
    assert [(bytes(r["code"]), r["error"], r["label_error"]) for r in few] == [(b"\0\0", 0, 0)] * 2
    assert V.compress(llm.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        V.compress(llm.createDataFrame([(1, [0.5, 0.1, 0.2], None)], VECTORS), parts=2)


# Benchmark passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_passages(text, items, window):
    found = list(WORD.finditer(fold(text)))
    words = [m[0] for m in found]
    hit, ids = set(), set()
    for name, texts in items.items():
        for t in texts:
            w = WORD.findall(fold(t))
            n = min(len(w), window)
            for part in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
                for i in range(len(words) - n + 1):
                    if tuple(words[i : i + n]) == part:
                        hit.update(range(i, i + n))
                        ids.add(name)
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][2] == i:
            spans[-1][1:] = [found[i].end(), i + 1]
        else:
            spans.append([found[i].start(), found[i].end(), i + 1])
    return len(words), len(hit), sorted(ids), [tuple(s[:2]) for s in spans]


@pytest.mark.parametrize("most", [D.MOST_BYTES, 60])
def test_passages_equal_plain_search(llm, odd_docs, monkeypatch, most):
    rng = random.Random(3)
    letters = ["a", "B", "é", "日本", "x9", "\x1c", "Ä", "ß"]
    line = lambda n: "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, line(rng.randint(1, 9))) for i in range(12)] + [(3, line(5)), (None, "zz Top"), (None, "a b a"), (50, ""), (51, None), (52, "... "), (53, "word word word word word")]
    docs = [(i, line(rng.randint(0, 60)) + "ZZ top! " * (i % 2)) for i in range(60)] + [(None, None), (5, ""), (5, ""), (6, items[0][1])]
    df = llm.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for name in ("raw", "rid", "runs", "item_ids", "n_words", "id", "t"):
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    bench = llm.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id", "2 as t")
    held = defaultdict(list)
    for i, t in items:
        held["" if i is None else str(i)].append(t)
    got = D.find_passages(df.repartition(3), bench, window=4, most=most).collect()
    every = docs + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = Counter((i, *map(str, plain_passages(t, held, 4))) for i, t in every)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["item_ids"]), str([tuple(s) for s in r["spans"]])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in got)


def test_long_texts_go_through_in_stretches(monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 16)
    rng = random.Random(9)
    items = [("a", [b"one two three four"]), ("b", [b"four"]), ("c", [b"two two"])]
    for _ in range(200):
        text = " ".join(rng.choice("one two three four five".split()) for _ in range(80))
        n, runs, held = D.Scanner(items, 4).scan(text.encode())
        want = plain_passages(text, {k: [t.decode() for t in v] for k, v in items}, 4)
        assert (n, sum(e - b for b, e in runs), sorted("abc"[i] for i in held), D.spans(text.encode(), runs)) == want


def test_passages_of_nothing(llm, no_docs, odd_docs):
    bench = llm.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert D.find_passages(no_docs, bench).count() == 0
    out = D.find_passages(odd_docs, bench.where("false")).collect()
    assert len(out) == odd_docs.count() and not any(r["contaminated"] for r in out)


# Collocations

def plain_collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= least}
        rows = []
        for p, a in good.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items()):
                continue
            s, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, n[lang], -s) for i, (s, a, g, left, right) in enumerate(sorted(rows)[:top])]
    return Counter(out)


def phrase_docs():
    rng = random.Random(11)
    words = ["the", "of", "New", "york", "é", "日本", "a\x01b", "x\x00", "\x1cq", *"bcdefgh"]
    docs = []
    for i in range(300):
        text = "".join(rng.choices(words, [30, 20, 8, 8, 5, 3, 2, 2, 2, *[4] * 7])[0] + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", "?"]) for _ in range(rng.randint(0, 60)))
        docs.append((text + " new york city hall" * (i % 3), rng.choice(["en", "en", "de", None])))
    return docs + [(None, "en"), ("", None), ("same words again and again", "xx")] + [("same words again and again", "xx")] * 40


@pytest.mark.parametrize("options", [{}, {"budget": 40, "buffer": 500}, {"budget": 200, "dictionary": 4, "buffer": 300}, {"dictionary": 1, "budget": 3000}])
def test_collocations_equal_plain_counts(llm, options):
    docs = phrase_docs()
    df = llm.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 as a", "2 as l", "3 as r", "4 as n", "'x' as phrase", "5 as word", "6 as raw", "7 as `group`").repartition(5)
    got = Counter(tuple(r) for r in P.collocations(df, 12, 50, **options).collect())
    assert got == plain_collocations(docs, 12, 50)


def test_prefixes_over_the_budget_are_prolonged(llm):
    coder = P.Coder([("en", b"w%d" % i) for i in range(50)], np.concatenate(([0], np.zeros(50, dtype=np.int64))), (1, 0), True)
    coder.total = 1
    coder.prolong(np.array([1]), np.array([1000]), 100)
    coder.prolong(np.array([1 << 20 | 2]), np.array([500]), 100)
    w = np.array([[1, 2, 3, 0], [1, 2, 4, 5], [1, 3, 0, 0], [2, 1, 2, 3]])
    g = coder.groups(w, np.empty(0, dtype=np.uint64))
    assert g[3] == 0 and 1 <= g[2] < 11 and all(11 <= x < 16 for x in g[:2])


def test_long_texts_are_cut_into_words_in_stretches(monkeypatch):
    text = ("one two\tthree, four  five\n" * 50).encode()
    whole = [w for part in P.pieces(text) for w in part if w]
    monkeypatch.setattr(P, "STRETCH", 7)
    assert [w for part in P.pieces(text) for w in part if w] == whole


def test_collocations_of_nothing(llm, no_docs, odd_docs):
    assert P.collocations(no_docs).count() == 0
    assert P.collocations(odd_docs, least=2).count() > 0
