"""Near dedup, top-k, token files and counts, language and mixing against direct versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import language as G
from folioframe.llm import mixing as M
from folioframe.llm import near_dedup as N
from folioframe.llm import token_counts as C
from folioframe.llm import token_files as B
from folioframe.llm import topk as K

SF = "/root/testdata/sf0.001"


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# Near dedup

def common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[-1]))
        line = new
    return line[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 25), st.integers(0, 6)), max_size=5))
def test_alignment_equals_plain_dynamic_programming(a, edits):
    b = list(a)
    for kind, at, value in edits:
        if kind == 0:
            b.insert(at, value)
        elif kind == 1 and at < len(b):
            del b[at]
        elif at < len(b):
            b[at] = value
    as_array = lambda v: np.array(v, dtype=np.uint64)
    best = common(a, b)
    want = bool(b) and best / (len(a) + len(b) - best) >= 0.8 - 1e-12
    assert N.alike(as_array(a), as_array(b), 0.8) == want


def test_labels_tell_repeats_apart():
    out = N.labelled(np.array([5, 7, 5, 5, 7], dtype=np.uint64))
    assert len(set(out.tolist())) == 5 and out[0] == 5 and out[1] == 7


def closed(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_classes_equal_all_pairs(llm):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, shared = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for c in range(rng.choice([1, 2, 6, 14])):
            rows.append((len(rows), " ".join(edited(base, rng, rng.choice([0, 1, 2, 4, 8])))))
            if c % 4 == 3:
                rows.append((len(rows), rows[-1][1]))
    rows += [(len(rows) + i, " ".join([word() for _ in range(80)] + shared)) for i in range(10)]
    seq = {d: N.shingles(t).tolist() for d, t in rows}
    links = [(a, b) for a in seq for b in seq if a < b and min(len(seq[a]), len(seq[b])) >= 0.8 * max(len(seq[a]), len(seq[b])) and set(seq[a]) & set(seq[b])
             and (k := common(seq[a], seq[b])) / (len(seq[a]) + len(seq[b]) - k) >= 0.8]
    want = closed(seq, links)
    assert len(set(want.values())) < len(rows) - 15
    out = N.near_classes(llm.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == want
    size = Counter(want.values())
    assert all(r["class_size"] == size[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_a_chain_of_many_is_one_class(llm):
    # Each text is near the next only: leaders alone do not link them, and the ends share little.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]
    out = N.near_classes(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_components(llm):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (50, 51), (300, 45)]
    out = {r["uid"]: r["comp"] for r in N.components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    want = closed({x for p in pairs for x in p}, pairs)
    assert out == want


def test_near_dedup_of_odd_rows(odd_docs, no_docs):
    out = N.near_classes(odd_docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _ in texts(odd_docs))
    of = defaultdict(set)
    for r in out:
        of[r["doc_id"]].add(r["class_id"])
    assert of[1] == of[2] == of[3] == of[10] == of[16] == {1}
    assert of[8] == of[9] == {8} and of[4] == {4} and of[6] == {6} and of[7] == {7}
    assert sum(r["kept"] for r in out if r["class_id"] == 1) == 1
    assert N.near_classes(no_docs).count() == 0


# Top-k

def direct(rows, queries, k):
    out = {}
    for q, v in queries:
        found = sorted((-sum(x * y for x, y in zip(v, w)), c) for c, w in rows if c != q)[:k]
        out[q] = [(c, -s) for s, c in found]
    return out


@pytest.mark.parametrize("high", [5, 300, 10**8])
def test_top_k_equals_all_scores(llm, high):
    rng = random.Random(high)
    rows = [(i, [rng.randrange(-high, high + 1) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [high, 0, 0, 0]) for i in range(60)] + [(i, v) for i, v in rows[:10]] + [(999, [high]), (998, [])]
    df = llm.createDataFrame(rows, "id long, v array<long>").repartition(5)
    queries = [r for r in rows if r[0] % 20 == 0]
    out = defaultdict(list)
    for r in sorted(K.top_k(df.where("id % 20 = 0"), df, 7, query_block=4, row_block=16).collect(), key=lambda r: r["rank"]):
        out[r["id"]].append((r["other"], r["score"]))
    want = direct(rows, {q[0]: q for q in queries}.values(), 7)
    assert out == want


def test_top_k_of_few_and_none(llm):
    df = llm.createDataFrame([(0, [1, 2]), (1, [3, 4])], "id long, v array<long>")
    assert [tuple(r) for r in K.top_k(df, df, 5).orderBy("id").collect()] == [(0, 1, 1, 11), (1, 1, 0, 11)]
    assert K.top_k(df.where("id = 0"), df.where("id = 0")).count() == 0
    assert K.top_k(df, df.where("false")).count() == 0


def test_usable_vectors(llm):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf"), 0.0]), (5, [-0.001])]
    df = llm.createDataFrame(rows, "id int, e array<float>").where(K.usable(K.F.col("e")))
    assert {r["id"]: r["v"] for r in df.select("id", K.whole_numbers(K.F.col("e")).alias("v")).collect()} == {0: [256, 512], 5: [-1]}


# Token files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


ALPHABET = ["a", "Bc", " ", " ", " ", "\n", "\t", "'s", "'", "é", "1", "½", ".", ",", "日", "\x85", "\x1d", "_", "!?", "'LL", "<|endoftext|>", "\U0001f600", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_encoder_equals_the_tokenizer(text):
    assert np.frombuffer(B.encoder(TOKENIZER, 2)(text), dtype="<u2").tolist() == plain_ids(text)


def test_token_files_round_trip(odd_docs, no_docs, fresh_dir):
    files = B.write_token_files(odd_docs, f"file://{fresh_dir}/t", TOKENIZER, file_bytes=200_000)
    order = sorted(texts(odd_docs), key=lambda r: (r[0] is not None, r[0] or 0))
    digest = B.token_digest(odd_docs, TOKENIZER, f"file://{fresh_dir}/u").collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in digest)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))
    assert [r["doc_id"] for r in sorted(digest, key=lambda r: r["start"])] == [d for d, _ in order]
    want = Counter()
    for d, t in order:
        ids = [*plain_ids(t), 2]
        want[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in digest) == want
    asked = odd_docs.where("doc_id in (2, 12) or doc_id is null").select("doc_id")
    got = B.read_documents(files, asked).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, (*plain_ids(t), 2)) for d, t in order if d in (2, 12, None))
    assert B.token_digest(no_docs, TOKENIZER, f"file://{fresh_dir}/v").count() == 0


def test_documents_of_a_batch_are_encoded_as_each_alone():
    texts = ["", " ", "a", " a", "a ", "a  b", "x.\n\nY z", "naïve café, où? ß", "x <|endoftext|> y", "a\x1cb c", "日本 語 word.", "", "one two, two. two", "tab\tx y", "don't 4a5 a-b"] * 2
    one = B.Encoder(TOKENIZER, 2)
    assert [bytes(ids) for ids in B.Encoder(TOKENIZER, 2).documents(texts)] == [one.document(t) for t in texts]
    assert list(one.documents([])) == []


def test_token_files_are_read_by_a_task_each(llm, fresh_dir):
    """The documents read back are many; neither do they go to every executor, nor does one task read all files."""
    docs = llm.range(400).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 20) text")
    files = B.write_token_files(docs, f"file://{fresh_dir}/m", TOKENIZER, file_bytes=1000)
    back = B.read_token_files(files)
    assert files.count() > 3 and back.selectExpr("file", "spark_partition_id() p").distinct().groupBy("p").count().where("count > 1").count() == 0
    plan = B.token_digest(docs, TOKENIZER, f"file://{fresh_dir}/n", file_bytes=1000)._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("BroadcastExchange"):]
    assert "Window" in sent and "MapInArrow" not in sent


def test_documents_are_encoded_as_the_given_tokenizer_does():
    from tokenizers import Tokenizer

    as_given, rng = Tokenizer.from_file(TOKENIZER), random.Random(11)
    for _ in range(500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25)))
        assert np.frombuffer(B.encoder(TOKENIZER, 2).document(text), dtype="<u2").tolist() == as_given.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_token_files(llm, fresh_dir):
    from tokenizers import Tokenizer

    given_, rows = Tokenizer.from_file(TOKENIZER), [(1, "one <|endoftext|> two"), (2, "<|endoftext|>"), (3, "plain text"), (4, "a<|endoftext|>\x1c<|endoftext|")]
    want, start = [], 0
    for d, t in rows:
        ids = [*given_.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    out = B.token_digest(llm.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, f"file://{fresh_dir}/a").collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == want


def test_frames_are_plain_zstandard_and_damage_is_seen(fresh_dir):
    fs, path = pafs.LocalFileSystem(), f"{fresh_dir}/one.bin"
    docs = [(3, np.arange(5, dtype="<u2").tobytes()), (None, b""), (9, np.arange(B.FRAME_IDS + 7, dtype="<u4").astype("<u2").tobytes())]
    assert B.write_file(fs, path, iter(docs), 2) == (3, 5 + B.FRAME_IDS + 7)
    held = B.TokenFile(fs, path)
    assert [held.doc_id(i) for i in range(3)] == [3, None, 9] and held.index["frames"].tolist() == [1, 1, 2]
    assert [b"".join(f.tobytes() for f in held.frames(i)) for i in range(3)] == [b for _, b in docs]
    raw = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw) == b"".join(b for _, b in docs)
    broken = bytearray(raw)
    broken[-15] ^= 1  # a checksum in the seek table
    open(path, "wb").write(bytes(broken))
    with pytest.raises(ValueError, match="damaged"):
        for i in range(3):
            list(B.TokenFile(fs, path).frames(i))


# Token counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_counts_follow_edits(data):
    count, piece = C.counter(*RANKS), st.lists(st.sampled_from([*ALPHABET, "word", " the", " of"]), max_size=40).map("".join)
    text, leaf = data.draw(piece), data.draw(st.sampled_from([2, 8, 64]))
    tree = C.Tree.of(text, count, leaf)
    for _ in range(4):
        place, removed, added = data.draw(st.integers(0, len(text) + 1)), data.draw(st.integers(0, 30)), data.draw(piece)
        at = min(place, len(text))
        want = text[:at] + added + text[at + removed :]
        tree, text, _ = tree.edit(text, place, removed, added, count, leaf)
        assert text == want and tree.length == len(text) and tree.tokens == count([text])[0]


def test_edit_table_and_odd_rows(llm, odd_docs, no_docs):
    edits = llm.createDataFrame([(1, 2, 0, 5, "Start "), (1, 1, 40, 10, None), (12, 1, 100000, 3, " middle of a long text "), (4, 1, 0, 0, "new"), (8, 1, None, None, "y")],
                                "doc_id long, seq int, place long, removed long, added string")
    out = C.apply_edits(C.attach_edits(C.with_trees(odd_docs, *RANKS), edits), *RANKS).collect()
    count = C.counter(*RANKS)
    old = defaultdict(set)
    for d, t in texts(odd_docs):
        old[d].add(count([t or ""])[0])
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["before"] in old[r["doc_id"]] and r["after"] == count([r["text"]])[0] == sum(r["leaves"]["tokens"])
    base = dict(texts(odd_docs.where("doc_id in (1, 8)")))
    by_id = {r["doc_id"]: r for r in out}
    once = base[1][:40] + base[1][50:]
    assert by_id[1]["text"] == "Start " + once[5:] and by_id[8]["text"] == "yx" and by_id[4]["text"] == "new"
    assert by_id[12]["encoded"] < 3000  # of 200,000 characters
    empty = C.attach_edits(C.with_trees(no_docs, *RANKS), edits)
    assert C.apply_edits(empty, *RANKS).count() == 0


# Language

def test_language_is_right_on_held_out_documents(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = G.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in out) <= 0.002 * len(out)


def test_language_of_odd_rows(llm, odd_docs, no_docs):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.learn_languages(docs)
    out = G.identify(odd_docs, model, ["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == odd_docs.count()
    for d in (4, 5, 6, 7):
        assert tuple(by_id[d])[1:] == ("und", 0.0, True)
    assert all(r["lang_pred"] in (*model.languages, "und") for r in out)
    foreign = llm.createDataFrame([(1, "γλώσσα που δεν έχει μάθει κανείς ποτέ " * 30), (2, "これは知らない言語の文章です" * 30)], "doc_id long, text string")
    assert all(r["rejected"] for r in G.identify(foreign, model, ["doc_id"]).collect())
    short = ["Ελλάδα χώρα της Ευρώπης", "γλώσσα που δεν έχει μάθει", "Привет мир это другой язык", "これは知らない言語の文章です", "これは知らない言語の文章ですから読めません" * 4, "Привет мир " * 15, "άγνωστη γλώσσα " * 12]
    for known in (docs, docs.where("doc_id < 150")):  # a large and a small table
        few = llm.createDataFrame([(i, t) for i, t in enumerate(short)], "doc_id long, text string")
        assert all(r["rejected"] for r in G.identify(few, G.learn_languages(known), ["doc_id"]).collect())
    assert (model.least > 0).all() and (np.diff(model.least) >= 0).all()
    assert G.identify(no_docs, model, ["doc_id"]).count() == 0
    none = G.identify(odd_docs, G.learn_languages(no_docs), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and all(r["rejected"] for r in none)


def test_long_texts_count_as_a_whole():
    text = ("abc déf " * 1000) + "xyz" * 100
    whole = G._grams([text])
    old, G._CHARS = G._CHARS, 4096
    try:
        parts = G.gram_counts([text, "short", text])
    finally:
        G._CHARS = old
    assert np.abs(parts[0] - whole[0]).sum() == 0 and (parts[1] == G._grams(["short"])[0]).all() and (parts[2] == parts[0]).all()


# Mixing

def test_rates_reach_the_targets(llm):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(1, 400)), [float(x) for x in rng.dirichlet([6, 1, 0.5, 0.5])]) for i in range(3000)]
    df = llm.createDataFrame(rows, "rid long, tokens long, p array<double>")
    goal = np.array([0.6, 0.2, 0.15, 0.05])
    rate, shares = M.fit_rates(df, tuple(goal))
    out = df.select("tokens", "p", rate.alias("r")).collect()
    total = sum(r["tokens"] for r in out)
    got = sum(np.array(r["p"]) * r["r"] * r["tokens"] for r in out) / total
    assert np.allclose(got, shares) and np.abs(got - goal).max() <= 1e-3
    assert all(r["r"] >= 0 for r in out)


def test_rates_are_the_least_squares_where_targets_cannot_be_reached(llm):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(1, 50)), [float(x) for x in rng.dirichlet([3, 3, 2, 2])]) for i in range(200)]
    df = llm.createDataFrame(rows, "rid long, tokens long, p array<double>")
    goal = np.array([0.97, 0.01, 0.01, 0.01])
    _, shares = M.fit_rates(df, tuple(goal), turns=60)
    # The same problem by many small projected steps.
    t, p = np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    t /= t.sum()
    w = np.linalg.inv(p.T @ (t[:, None] * p) + 1e-6 * np.eye(4))
    r = np.ones(len(rows))
    for _ in range(20000):
        r = np.clip(r - 0.5 * (p @ (w @ (p.T @ (t * r) - goal))), 0, 4)
    gap = lambda s: (s - goal) @ w @ (s - goal)
    assert gap(shares) <= gap(p.T @ (t * r)) * 1.02 + 1e-9


def test_rates_reach_a_rare_target_domain(llm):
    rows = [(i, 10, [0.97, 0.01, 0.01, 0.01] if i % 20 < 3 else [0.01, 0.97, 0.01, 0.01]) for i in range(400)]
    df = llm.createDataFrame(rows, "rid long, tokens long, p array<double>")
    goal = (0.9, 0.08, 0.01, 0.01)
    rate, shares = M.fit_rates(df, goal)
    assert np.abs(shares - np.array(goal)).max() <= 1e-3 and df.select(M.F.max(rate)).first()[0] > 4
    capped, reached = M.fit_rates(df, goal, most=4.0)
    assert df.select(M.F.max(capped)).first()[0] <= 4 and reached[0] < 0.62


def test_mixing_of_documents(llm, odd_docs, no_docs):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = M.mix(docs, labels).join(labels, "doc_id", "left").collect()
    mean = lambda q, t: np.mean([r["rate"] for r in out if (r["quality"], r["toxic"]) == (q, t)])
    assert mean(1, 0) > 1 and mean(1, 1) < 0.5
    total = sum(r["tokens"] for r in out)
    got = sum(np.array(r["p"]) * r["rate"] * r["tokens"] for r in out) / total
    assert np.abs(got - np.array(M.WEIGHTS)).max() <= 1e-3
    assert abs(sum(r["copies"] * r["tokens"] for r in out) / total - 1) < 0.1
    odd = M.mix(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in odd)
    assert M.mix(no_docs, labels).count() == 0 and M.mix(odd_docs, labels.where("false")).count() == len(odd)


def test_labels_of_other_documents_do_not_use_up_the_sample(llm):
    docs, labels = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    foreign = llm.range(10_000, 30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    own, mixed = M.fit_classifier(docs, labels, most=60), M.fit_classifier(docs, labels.unionByName(foreign.select(labels.columns)), most=60)
    assert len(own.weights) and (own.row == mixed.row).all() and np.allclose(own.weights, mixed.weights)
