"""Known cases of the document rules."""

import pytest
from pyspark.sql import functions as F
from rows import row, table

from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import continuation as C
from folioframe.operators import explain as E
from folioframe.operators import merges as M
from folioframe.operators import ordering as O

LO, HI = 45.0, 546.0


def lit_box(b):
    return G.Box(*[F.lit(float(v)) for v in b])


@pytest.mark.parametrize("prev,nxt,line_h,pages,expected", [
    ((47, 462, 288, 604), (304, 331, 546, 385), 12.0, (1, 1), True),
    ((47, 100, 288, 150), (304, 300, 546, 360), 12.0, (1, 1), False),
    ((304, 100, 546, 200), (47, 300, 288, 400), 12.0, (1, 1), False),
    ((47, 100, 288, 150), (47, 160, 288, 210), 0.0, (1, 1), True),
    ((47, 300, 546, 350), (304, 100, 546, 160), 12.0, (1, 1), False),
    ((304, 600, 546, 700), (47, 80, 288, 160), 12.0, (1, 2), True),
])
def test_continuation_geometry(spark, prev, nxt, line_h, pages, expected):
    ok = G.continuation_geometry_ok(lit_box(prev), F.lit(pages[0]), lit_box(nxt), F.lit(pages[1]), F.lit(line_h), F.lit(0.0),
                                    F.lit(LO), F.lit(HI), F.lit(LO), F.lit(HI))
    assert spark.range(1).select(ok).first()[0] is expected


@pytest.mark.parametrize("tops,expected", [
    ([], None), ([629.5], 629.5), ([613.0, 631.2, 674.2], None), ([600.0, 689.0], None), ([560.0, 700.0, 740.0], 560.0), ([600.0, 700.0], 600.0)])
def test_isolated_separator(spark, tops, expected):
    df = spark.createDataFrame([(1, 1, y) for y in tops], "doc_id long, page int, y double")
    got = [r["sep_y"] for r in O.isolated_separator(df).collect()]
    assert got == ([] if expected is None else [expected])


def test_layout_types(spark):
    rows = [row("paragraph", "x", 50, 100, 550, 130, 0), row("paragraph", "x", 50, 140, 280, 200, 1), row("paragraph", "x", 320, 140, 550, 200, 2),
            row("paragraph", "x", 200, 100, 400, 130, 3, page=2), row("paragraph", "x", 60, 100, 240, 130, 4, page=2), row("paragraph", "x", 360, 100, 540, 130, 5, page=2)]
    got = {r["ri"]: r["layout_type"] for r in C.with_layout_type(table(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == ["one-column", "left-column", "right-column", "one-column"]


@pytest.mark.parametrize("prev,cur,ok", [
    ("one-column", "left-column", True), ("one-column", "right-column", False), ("left-column", "right-column", True), ("right-column", "right-column", True),
    ("one-column", "one-column", True), ("left-column", "left-column", True), ("right-column", "left-column", True), (None, "right-column", False), (None, "left-column", True)])
def test_predecessor(spark, prev, cur, ok):
    df = spark.createDataFrame([(prev, cur)], "p string, c string")
    assert df.select(G.layout_predecessor_ok("p", "c")).first()[0] is ok


NOTE_CASES = {
    "labelled": ([row("caption", "Table 1. Yield by season.", 60, 90, 540, 110, 0), row("table", "", 60, 120, 540, 200, 1),
                  row("paragraph", "Note. Twelve plots each.", 60, 210, 400, 235, 2)], 1),
    "wedged": ([row("table", "", 60, 120, 540, 200, 0), row("paragraph", "Rain fell on most of the valley.", 60, 210, 290, 320, 1),
                row("paragraph", "Farmers moved the herds uphill early.", 60, 330, 290, 440, 2), row("paragraph", "Along the coast the weather stayed dry.", 320, 210, 540, 300, 3),
                row("paragraph", "Note. Weights in tonnes, rounded.", 320, 310, 540, 340, 4)], 4),
    "letter": ([row("table", "", 60, 120, 540, 200, 0), row("paragraph", "a. Estimated from the two nearest stations.", 60, 380, 420, 405, 1)], 1),
}


@pytest.mark.parametrize("name", NOTE_CASES)
def test_table_takes_its_note(spark, name):
    rows, left = NOTE_CASES[name]
    out = M.merge_tables_linear(table(spark, rows)).collect()
    assert len(out) == left
    tab = next(r for r in out if r["role"] == "table")
    assert rows[-1][5] in tab["text"] and rows[-1][5] in tab["caption_text"] and tab["ri"] == 0


def test_figure_keeps_off_notes(spark):
    rows = [row("figure", "", 60, 120, 540, 200, 0), row("paragraph", "Note. Shaded parts lie under water.", 60, 210, 400, 235, 1)]
    assert len(M.merge_tables_linear(table(spark, rows)).collect()) == 2


def test_page_table_takes_its_note(spark):
    rows = [row("paragraph", "Some prose before it.", 60, 60, 290, 110, 0), row("table", "", 60, 120, 290, 200, 1, caption="Table 1. Harvest."),
            row("paragraph", "Note. Weights in tonnes, rounded.", 60, 210, 290, 240, 2), row("figure", "", 320, 120, 540, 200, 3, caption="Figure 1. Map."),
            row("paragraph", "Note. Shaded parts lie under water.", 320, 210, 540, 240, 4)]
    out = {r["ri"]: r for r in M.merge_table_notes_pages(table(spark, rows, pages=True)).collect()}
    assert sorted(out) == [0, 1, 3, 4]
    assert out[1]["caption_text"] == "Table 1. Harvest.\nNote. Weights in tonnes, rounded." and out[1]["y1"] == 240
    assert out[3]["caption_text"] == "Figure 1. Map."


def test_hash_and_latex(spark):
    df = spark.createDataFrame([("hello",), ("",), ("né 𝄞",)], "t string")
    got = [r[0] for r in df.select(E.djb2_base36(F.col("t"))).collect()]

    def want(s):
        h = 5381
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h * 33) ^ int.from_bytes(raw[k:k + 2], "big")) & 0xFFFFFFFF
        out = ""
        while h:
            out, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out, h // 36
        return out or "0"

    assert got == [want(s) for s in ("hello", "", "né 𝄞")]
    assert spark.range(1).select(T.wrap_bare_latex(F.lit("\\frac{a}{b}"))).first()[0] == "$$\\frac{a}{b}$$"


@pytest.mark.parametrize("text,expected", [
    ("a $x$ b", [("text", "a "), ("math", "x"), ("text", " b")]), ("cost \\$5", [("text", "cost $5")]), ("$$y$$\\(z\\)", [("math", "y"), ("math", "z")]),
    ("\\[w\\] $", [("math", "w"), ("text", " $")]), ("$$$$x", [("text", "$$$$x")]), ("plain", [("text", "plain")])])
def test_math_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert [(t["type"], t["value"]) for t in df.select(E.tokenize_math(F.col("t"))).first()[0]] == expected


def test_best_window_prefers_declared_sentences(spark):
    texts = ["Alpha networks converge quickly.", "Beta systems store tensors.", "Alpha networks converge again."]
    df = spark.createDataFrame([(texts, [2], "alpha network converges", [])], "texts array<string>, indices array<int>, quote string, terms array<string>")
    r = E.resolve_sentences(df).first()
    assert (r["tier"], r["resolved"]) == (3, [2])
    df = spark.createDataFrame([(texts, [9], "tensors stored beta", [])], "texts array<string>, indices array<int>, quote string, terms array<string>")
    r = E.resolve_sentences(df).first()
    assert (r["tier"], r["resolved"]) == (3, [1])


def test_literal_quote_across_hyphens(spark):
    df = spark.createDataFrame([(["We train net- works here.", "They work."], [], "networks here. They", [])], "texts array<string>, indices array<int>, quote string, terms array<string>")
    r = E.resolve_sentences(df).first()
    assert (r["tier"], r["resolved"]) == (2, [0, 1])


def test_concepts_land_on_fused_card(spark):
    card = lambda q, k, terms: ([k], q, [(t, "e") for t in terms], False, True)
    df = spark.createDataFrame([([card("One two.", 0, ["two"]), card("Three four.", 1, ["TWO", "four"]), card("Five.", 2, [])], "two. Three", [("one", "n"), ("Four", "n")])],
                               f"items array<{E.CARD}>, fragment string, new_concepts array<struct<term:string,explanation:string>>")
    r = E.inject_concepts(df).first()
    assert r["covered"] == [0, 1] and [i["quote"] for i in r["items"]] == ["One two. Three four.", "Five."]
    assert [c["term"] for c in r["items"][0]["concepts"]] == ["one", "two", "four"] and r["items"][0]["sentence_indices"] == [0, 1]
