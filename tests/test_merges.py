"""Merges: cases worked out by hand, and what must hold on any page."""

import random
from collections import Counter, defaultdict

import pytest
from rows import row, table

from folioframe.operators import merges as M

KINDS = ["Plain body text {}.", "Figure 3. Shape {}.", "Table 2. Values {}.", "(a) left part {}", "(b) right part {}", "Source: office {}", "Note. Means {}.", "More prose {}."]
VISUAL = ("figure", "table")


def page(rng, doc, number, first):
    """Rows of one page, each text different from all others."""
    out, y = [], 50.0
    for ri in range(first, first + rng.randint(2, 9)):
        role = rng.choice(["figure", "figure", "table", "paragraph", "paragraph", "caption", "equation"])
        x, h, w = rng.choice([50.0, 50.0, 310.0]), rng.choice([12.0, 60.0, 120.0]), rng.choice([240.0, 500.0])
        text = "" if role in VISUAL else rng.choice(KINDS).format(f"{doc}x{ri}")
        out.append(row(role, text, x, y, x + w, y + h, ri, page=number, doc=doc))
        y += rng.choice([-20.0, 14.0, 14.0, 70.0])
    return out


@pytest.fixture(scope="module")
def corpus():
    rng, out = random.Random(11), []
    for doc in range(60):
        ri = 0
        for number in range(1, rng.randint(2, 6)):
            rows = page(rng, doc, number, ri)
            ri += len(rows)
            out += rows
    return out


def box(r):
    return (r["x0"], r["y0"], r["x1"], r["y1"])


def hull(boxes):
    xs = list(zip(*boxes))
    return (min(xs[0]), min(xs[1]), max(xs[2]), max(xs[3]))


def check_parts(corpus, result, takes):
    """Every text is left once or used once, by its own document; owners cover their parts and nothing else moves."""
    before = {(r[0], r[2]): r for r in corpus}
    by_text = {r[5]: r for r in corpus if r[5]}
    used, left = Counter(), Counter()
    gone = set(before) - {(r["doc_id"], r["ri"]) for r in result}
    panels = defaultdict(list)
    for key in gone:
        if before[key][4] in VISUAL:
            panels[key[0]].append(before[key])
    for r in result:
        old = before[r["doc_id"], r["ri"]]
        lines = [t for t in (r["caption_text"] or "").split("\n") if t]
        if not lines and box(r) == old[6:10]:
            assert (r["role"], r["text"]) == (old[4], old[5])
            left.update([old[5]] if old[5] else [])
            continue
        assert r["role"] in VISUAL
        parts = [by_text[t] for t in lines]
        assert all(p[0] == r["doc_id"] and takes(p) for p in parts)
        used.update(lines)
        # The box is the hull of the owner, its texts and absorbed visuals.
        inside = [p for p in panels[r["doc_id"]] if p[6] >= r["x0"] and p[7] >= r["y0"] and p[8] <= r["x1"] and p[9] <= r["y1"]]
        own = [old] if old[4] in VISUAL else []
        assert hull([p[6:10] for p in [*own, *parts, *inside]]) == box(r)
    assert used + left == Counter(by_text.keys()), "a text is lost or used twice"


def caption_like(p):
    return p[4] == "caption" or p[5].startswith(("Figure", "Table", "(a)", "(b)", "Source:"))


def test_captions_linear_on_random_documents(spark, corpus):
    rows = M.merge_figure_captions_linear(table(spark, corpus)).collect()
    assert len(rows) < len(corpus)
    check_parts(corpus, rows, caption_like)


def test_captions_pages_on_random_pages(spark, corpus):
    rows = M.merge_figure_captions_pages(table(spark, corpus, pages=True)).collect()
    assert len(rows) < len(corpus)
    check_parts(corpus, rows, caption_like)
    at = {(r[0], r[2]): r[1] for r in corpus}
    by_text = {r[5]: r for r in corpus if r[5]}
    assert all(by_text[t][1] == at[r["doc_id"], r["ri"]] for r in rows for t in r["caption_text"].split("\n") if t)  # nothing crosses a page


def captions(spark, rows):
    return {r["ri"]: (r["caption_text"], box(r)) for r in M.merge_figure_captions_linear(table(spark, rows)).collect()}


def test_nearer_caption_wins(spark):
    fig = row("figure", "", 50, 100, 290, 160, 1)
    above, below = row("caption", "Figure 1. Above.", 50, 80, 290, 90, 0), row("caption", "Figure 2. Below.", 50, 180, 290, 192, 2)
    assert captions(spark, [above, fig, below]) == {1: ("Figure 1. Above.", (50, 80, 290, 160)), 2: ("", (50, 180, 290, 192))}
    near = row("caption", "Figure 2. Below.", 50, 165, 290, 177, 2)
    assert captions(spark, [above, fig, near]) == {0: ("", (50, 80, 290, 90)), 1: ("Figure 2. Below.", (50, 100, 290, 177))}


def test_source_follows_caption(spark):
    rows = [row("figure", "", 50, 100, 290, 160, 0), row("caption", "Figure 1. Shape.", 50, 165, 290, 177, 1), row("paragraph", "Source: census", 50, 180, 290, 192, 2), row("paragraph", "Prose.", 50, 195, 290, 207, 3)]
    assert captions(spark, rows) == {0: ("Figure 1. Shape.\nSource: census", (50, 100, 290, 192)), 3: ("", (50, 195, 290, 207))}


def test_panels_join_when_stacked_and_stay_apart_when_far(spark):
    rows = [row("figure", "", 50, 100, 290, 160, 0), row("paragraph", "(a) first part", 50, 162, 290, 172, 1), row("figure", "", 50, 176, 290, 236, 2), row("caption", "Figure 1. Both.", 50, 240, 290, 252, 3)]
    assert captions(spark, rows) == {0: ("(a) first part\nFigure 1. Both.", (50, 100, 290, 252))}
    rows = [row("figure", "", 50, 100, 290, 160, 0), row("figure", "", 50, 360, 290, 420, 1)]
    assert captions(spark, rows) == {0: ("", (50, 100, 290, 160)), 1: ("", (50, 360, 290, 420))}


def test_a_long_run_of_figures_keeps_every_figure_or_joins_it(spark):
    rows = [row("figure", "", 50, 100 + 70 * (i % 9), 290, 160 + 70 * (i % 9), i, page=i // 9 + 1) for i in range(90)]
    out = M.merge_figure_captions_linear(table(spark, rows)).collect()
    check_parts(rows, out, caption_like)


def test_segments_of_long_runs_give_what_one_fold_gives(spark, monkeypatch):
    """Runs without an end, over many pages: cut into segments, and folded as a whole."""
    rng, rows = random.Random(5), []
    for doc in range(40):
        y = 50.0
        for ri in range(120):
            if ri % 7 == 0:
                y = 50.0
            role = rng.choice(["figure", "figure", "table", "caption", "caption", "paragraph"])
            text = {"caption": "Figure 3. Shape {}.", "paragraph": rng.choice(["(a) part {}", "Source: office {}", "Figure 4. Form {}."])}.get(role, rng.choice(["", "", "", "(b) in {}"])).format(f"{doc}x{ri}")
            h = rng.choice([12.0, 60.0])
            rows.append(row(role, text, 50, y, 290, y + h, ri, page=ri // 7 + 1, doc=doc))
            y += rng.choice([10.0, 14.0, 70.0])
    df = table(spark, rows)
    cols = ["doc_id", "page", "ri", "role", "text", "x0", "y0", "x1", "y1", "caption_text"]
    cut = sorted(map(str, M.merge_figure_captions_linear(df).select(cols).collect()))
    assert M.caption_segments(df).count() > 20 * M.caption_segments(df, cut=False).count() / 2
    whole = M.caption_segments
    monkeypatch.setattr(M, "caption_segments", lambda rows: whole(rows, cut=False))
    assert sorted(map(str, M.merge_figure_captions_linear(df).select(cols).collect())) == cut


def test_ten_thousand_figures_in_a_row_are_many_segments(spark):
    rows = [row("figure", "", 50, 100 + 70 * (i % 9), 290, 160 + 70 * (i % 9), i, page=i // 9 + 1) for i in range(10_000)]
    segments = M.caption_segments(table(spark, rows))
    sizes = [r[0] for r in segments.selectExpr("size(arr)").collect()]
    assert len(sizes) == 1112 and max(sizes) == 9 and sum(sizes) == 10_000


def tables(spark, rows):
    return {r["ri"]: (r["role"], r["caption_text"], box(r)) for r in M.merge_tables_linear(table(spark, rows)).collect()}


def test_tables_on_random_documents(spark, corpus):
    before = {(r[0], r[2]): r for r in corpus}
    by_text = {r[5]: r for r in corpus if r[5]}
    out = M.merge_tables_linear(table(spark, corpus)).collect()
    used = Counter(t for r in out for t in (r["caption_text"] or "").split("\n") if t)
    left = Counter(before[r["doc_id"], r["ri"]][5] for r in out if not r["caption_text"] and before[r["doc_id"], r["ri"]][5])
    assert used + left == Counter(by_text.keys()) and used
    for r in out:
        if r["caption_text"]:
            parts = [by_text[t] for t in r["caption_text"].split("\n")]
            assert r["role"] == "table" and all(p[0] == r["doc_id"] and p[1] == r["page"] for p in parts)
            assert hull([p[6:10] for p in parts] + [box(r)]) == box(r)
        else:
            assert box(r) == before[r["doc_id"], r["ri"]][6:10]


def test_table_with_label_and_note(spark):
    label, body = row("caption", "Table 2. Rates.", 60, 90, 540, 110, 0), row("table", "", 60, 120, 540, 200, 1)
    near, far = row("paragraph", "Note. In percent.", 60, 205, 400, 220, 2), row("paragraph", "Note. In percent.", 60, 420, 400, 440, 2)
    assert tables(spark, [label, body, near]) == {0: ("table", "Table 2. Rates.\nNote. In percent.", (60, 90, 540, 220))}
    assert tables(spark, [label, body, far]) == {0: ("table", "Table 2. Rates.", (60, 90, 540, 200)), 2: ("paragraph", "", (60, 420, 400, 440))}
    beside = row("paragraph", "Note. In percent.", 545, 205, 590, 220, 2)  # does not lie below the table
    assert set(tables(spark, [label, body, beside])) == {0, 2}
    other = row("table", "", 60, 120, 540, 200, 1, page=2)
    assert tables(spark, [label, other]) == {0: ("caption", "", (60, 90, 540, 110)), 1: ("table", "", (60, 120, 540, 200))}


def test_merge_groups(spark):
    from folioframe.operators.edits import replay_merge_groups

    m = lambda k, kind="block": (f"{kind}:1:{k}", kind, 1, None)
    log = [(1, 0, "merge", [m(1), m(2)]), (1, 1, "merge", [m(3), m(4, "image")]), (1, 2, "merge", [m(2), m(3)]), (1, 3, "cut", [m(1)]), (2, 0, "merge", [m(1)]), (2, 1, "merge", [m(1), m(2)]), (2, 2, "cut", [m(2)])]
    df = spark.createDataFrame(log, "doc_id long, edit_id long, op string, members array<struct<key:string,kind:string,page:int,role:string>>")
    out = replay_merge_groups(df).collect()
    assert [(r["doc_id"], r["group_id"], [x["key"] for x in r["members"]], r["result_role"]) for r in out] == [
        (1, "mg-1-block11-block12", ["block:1:2", "block:1:3", "image:1:4"], "figure")]


def test_merge_groups_by_component_equal_whole_logs(spark, monkeypatch):
    from folioframe.operators import edits as D

    rng, log = random.Random(7), []
    for doc in range(30):
        for edit in range(rng.randint(1, 25)):
            some = sorted(rng.sample(range(24), rng.randint(0, 4)))
            op = rng.choice(["merge", "merge", "cut"])
            members = [(f"block:{k // 6}:{k}", rng.choice(["block", "block", "image"]), k // 6, rng.choice([None, "table"])) for k in some[: 1 if op == "cut" else 4]]
            log.append((doc, edit, op, members))
    df = spark.createDataFrame(log, "doc_id long, edit_id long, op string, members array<struct<key:string,kind:string,page:int,role:string>>")
    parts = D.edit_components(df)
    assert parts.select("doc_id", "comp").distinct().count() > parts.select("doc_id").distinct().count()
    by_part = sorted(map(str, D.replay_merge_groups(df).collect()))
    monkeypatch.setattr(D, "edit_components", lambda log: log.selectExpr("*", "0 as comp"))
    assert sorted(map(str, D.replay_merge_groups(df).collect())) == by_part and by_part


def test_components(spark):
    from folioframe.operators.components import components

    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (None, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 201: 200, 202: 200}
