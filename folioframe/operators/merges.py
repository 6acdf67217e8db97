"""Order-dependent merges: captions, tables, notes and algorithms drawn into one block.

A merge works in two steps. Slim candidates (place, box and flags, no text) are gathered by page, or by segment of a run of
figures, and folded with ``aggregate``; what comes out is a table of picks, one small row per block that
another block takes. The picks are then joined back: taken rows leave, and their owners are filled from them. All of it stays in the JVM.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.functions.arrays import let
from folioframe.operators import scans
from folioframe.session import settle
from folioframe.sources import layout
from folioframe.sources.layout import PAGE_KEY

BOX = "x0:double,y0:double,x1:double,y1:double"
ROW_KEY = [*PAGE_KEY, "ri"]


def gather(rows: DataFrame, keys: list) -> DataFrame:
    """One row per group with its rows as the array ``arr`` in reading order."""
    fields = ["ri"] + [c for c in rows.columns if c not in (*keys, "ri")]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("arr"))


def _as_boxes(parts):
    return F.transform(parts, lambda p: F.struct(*[p[c].alias(c) for c in G.Box._fields]))


def _texts(parts, field="text"):
    return F.filter(F.transform(parts, lambda p: p[field]), lambda t: t != "")


def _apply(rows: DataFrame, picks: DataFrame, texts: DataFrame | None, fields: list, fill: dict) -> DataFrame:
    """Rows without those that were taken; owners have the columns in ``fill``, which read ``parts``: what they took, as structs of ``fields``.

    ``picks`` has ROW_KEY, the place of the owner (ospan, opage, owner) and what ``fields`` names beyond the columns of ``texts``; an owner may be among its own
    parts. ``texts`` are the same rows with fewer columns, where these are cheaper to come by.
    """
    picks = settle(picks)
    source = rows if texts is None else texts
    took = source.join(picks, ROW_KEY).select("doc_id", F.col("ospan").alias("span"), F.col("opage").alias("page"), F.col("owner").alias("ri"), F.struct(*fields).alias("part"))
    parts = scans.by_span(took).groupBy(*ROW_KEY).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    gone = picks.where("ri != owner or page != opage").select(*ROW_KEY)
    # ``own_ri``: the number of the owner, also where ``ri`` is filled anew.
    out = rows.join(gone, ROW_KEY, "left_anti").join(parts, ROW_KEY, "left").withColumn("own_ri", F.col("ri"))
    filled = lambda c: F.when(F.col("parts").isNotNull(), fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c)
    return out.select(*[filled(c) for c in rows.columns])


# -- captions --------------------------------------------------------------------------------------------

_PICK = "struct<ri:int,page:int,owner:int,opage:int,panel:boolean,n:int>"
_NEAR = "struct<ri:int,page:int,cap:boolean,y1:double>"
_OPEN = (
    f"struct<done:array<{_PICK}>,held:array<{_PICK}>,ri:int,page:int,y0:double,y1:double,u:struct<{BOX}>,"
    "have_cap:boolean,have_src:boolean,saw:boolean,above_ri:int,above_page:int,above_y1:double,fwd_ri:int,fwd_y0:double,"
    f"last_ri:int,p1:{_NEAR},p2:{_NEAR}>"
)


def _near(e) -> F.Column:
    return F.struct(e["ri"].alias("ri"), e["page_no"].alias("page"), (e["cap"] & ~e["vis"]).alias("cap"), e["y1"].alias("y1"))


def _caption_fold(arr, pages: bool, lead=None) -> F.Column:
    """Which rows each figure or table takes: sub-captions, panels, one caption, one source line.

    The state is the open figure with what it holds so far. A row the figure cannot take closes it; on
    closing, the nearer one of the captions above and below stays with the figure. ``lead`` is the row before the first one.
    """
    no_picks = F.array().cast(f"array<{_PICK}>")
    null = F.lit(None)

    def pick(row, s, panel):
        return F.array(F.struct(row["ri"].alias("ri"), row["page"].alias("page"), s["ri"].alias("owner"), s["page"].alias("opage"), panel.alias("panel"), F.size(s["held"]).alias("n")))

    def state(**parts):
        return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(_OPEN)

    def closed(s):
        wins = s["above_ri"].isNotNull() & (
            s["fwd_ri"].isNull() | (s["y0"] - s["above_y1"] <= s["fwd_y0"] - s["y1"])
        )
        kept = F.filter(s["held"], lambda h: ~F.coalesce(h["ri"] == s["fwd_ri"], F.lit(False)))
        with_above = F.concat(kept, pick({"ri": s["above_ri"], "page": s["above_page"]}, s, F.lit(False)))
        return F.when(s["ri"].isNull(), s["done"]).when(wins, F.concat(s["done"], with_above)).otherwise(
            F.concat(s["done"], s["held"])
        )

    def step(s, e):
        me, u = G.box_of(e), G.box_of(s["u"])
        is_open = s["ri"].isNotNull()
        if pages:
            is_open = is_open & (e["ri"] == s["last_ri"] + 1)
        bare = ~(s["have_cap"] | s["have_src"])
        sub = e["sub"] & bare & (G.h_overlap(u, me) >= V.PANEL_H_OVERLAP)
        cap = ~s["have_cap"] & e["cap"]
        src = ~s["have_src"] & e["src"]
        panel = (
            e["vis"] & bare & (s["saw"] | s["above_ri"].isNull()) & (e["page_no"] == s["page"])
            & (G.panels_contiguous(u, me) | G.panels_side_by_side(u, me))
        )
        act = F.when(~is_open, 0).when(sub, 1).when(cap, 2).when(src, 3).when(panel, 4).otherwise(0)

        def absorb(a):
            return state(
                done=s["done"], held=F.concat(s["held"], pick({"ri": e["ri"], "page": e["page_no"]}, s, a == 4)),
                ri=s["ri"], page=s["page"], y0=s["y0"], y1=s["y1"],
                u=F.when(a == 4, G.box_struct(u, me)).otherwise(s["u"]),
                have_cap=s["have_cap"] | (a == 2), have_src=s["have_src"] | (a == 3),
                saw=F.when(a == 4, False).otherwise(s["saw"] | (a == 1)),
                above_ri=s["above_ri"], above_page=s["above_page"], above_y1=s["above_y1"],
                fwd_ri=F.when(a == 2, e["ri"]).otherwise(s["fwd_ri"]),
                fwd_y0=F.when(a == 2, e["y0"]).otherwise(s["fwd_y0"]),
                last_ri=e["ri"], p1=_near(e), p2=s["p1"],
            )

        def restart(done):
            def usable(p, back):
                near = (p["ri"] == e["ri"] - back) if pages else (F.lit(back == 1) & p["ri"].isNotNull())
                return near & p["cap"] & ~F.exists(done, lambda d: d["ri"] == p["ri"])

            above = (
                F.when(usable(s["p1"], 1), s["p1"]).when(usable(s["p1"], 2), s["p1"]).when(usable(s["p2"], 2), s["p2"])
            )
            opens = e["vis"]
            return state(
                done=done, held=no_picks, ri=F.when(opens, e["ri"]), page=F.when(opens, e["page_no"]),
                y0=e["y0"], y1=e["y1"], u=G.box_struct(me), have_cap=F.lit(False), have_src=F.lit(False),
                saw=F.lit(False), above_ri=F.when(opens, above["ri"]), above_page=F.when(opens, above["page"]), above_y1=F.when(opens, above["y1"]),
                fwd_ri=null, fwd_y0=null, last_ri=e["ri"], p1=_near(e), p2=s["p1"],
            )

        return let(act, lambda a: F.when(a > 0, absorb(a)).otherwise(let(closed(s), restart)))

    start = state(
        done=no_picks, held=no_picks, ri=null, page=null, y0=null, y1=null, u=null, have_cap=F.lit(False),
        have_src=F.lit(False), saw=F.lit(False), above_ri=null, above_page=null, above_y1=null, fwd_ri=null, fwd_y0=null,
        last_ri=null, p1=null if lead is None else lead, p2=null,
    )
    return F.aggregate(arr, start, step, closed)


def _caption_flags(vis) -> dict:
    no = F.lit(False)
    return {
        "vis": vis, "page_no": F.col("page"),
        "sub": F.when(F.col("text") != "", T.is_subfigure_caption("text")).otherwise(no),
        "cap": F.coalesce(T.is_caption_block("role", "text"), no),
        "src": F.coalesce(T.is_source_attribution("role", "text"), no),
    }


PART = ["step", "y0", "n", "panel", "x0", "x1", "y1", "text"]


def _with_captions(notes: bool = False, spoken: bool = False) -> dict:
    """Owners: pieces top to bottom as caption, then the note; boxes joined; with ``spoken``, the sentences of the first piece that has some."""
    first = F.filter("parts", lambda p: p["step"] == 2)
    pieces = F.filter("parts", lambda p: (p["step"] == 2) & ~p["panel"])
    own = F.array(F.struct(*G.Box._fields))
    box = G.union_bbox(F.concat(own, _as_boxes(F.col("parts"))))
    caption = F.when(F.size(first) > 0, F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")).otherwise(F.col("caption_text"))
    caption_box = F.when(F.size(first) > 0, F.when(F.size(pieces) > 0, G.union_bbox(_as_boxes(pieces)))).otherwise(F.col("caption_bbox"))
    if notes:
        note = F.get(F.filter("parts", lambda p: p["step"] == 3), F.lit(0))
        with_box = lambda c: F.when(c.isNull(), G.box_struct(G.box_of(note))).otherwise(G.box_struct(G.box_of(c), G.box_of(note)))
        caption_box = let(caption_box, lambda c: F.when(note.isNotNull(), with_box(c)).otherwise(c))
        caption = let(caption, lambda c: F.when(note.isNotNull(), F.concat_ws("\n", F.when(c != "", c), note["text"])).otherwise(c))
    fill = {"caption_text": caption, "caption_bbox": caption_box, **{c: box[c] for c in G.Box._fields}}
    if spoken:
        said = F.filter(F.transform(pieces, lambda p: p["sentences"]), lambda s: F.size(s) > 0)
        fill["sentences"] = F.when(F.size(said) > 0, F.get(said, F.lit(0))).otherwise(F.col("sentences"))
    return fill


_PART = "struct<ri:int,owner:int,panel:boolean,n:int,step:int>"


def _page_picks(rows: DataFrame, captions: bool, notes: bool) -> DataFrame:
    """What figures and tables of a page take: captions first; then each table the closest note below it that is left, tables in order.

    Rows that are none of these only break a caption off its figure, which their numbers show; so they need not be there.
    """
    no = F.lit(False)
    flags = _caption_flags(F.col("kind") == "image")
    flags["note"] = F.coalesce((F.col("kind") == "block") & T.is_table_note("role", "text"), no) if notes else no
    flags["tab"] = flags["vis"] & (F.col("role") == "table")
    joins = F.col("vis") | F.col("sub") | F.col("cap") | F.col("src") if captions else F.col("vis")
    slim = rows.select(*ROW_KEY, *G.Box._fields, *[c.alias(k) for k, c in flags.items()]).withColumn("joins", joins).where("joins or note")
    some = slim.withColumn("any", F.max("vis").over(Window.partitionBy(*PAGE_KEY)) & (F.count(F.lit(1)).over(Window.partitionBy(*PAGE_KEY)) > 1)).where("any").drop("any")
    g = gather(some, PAGE_KEY).withColumn("first", _caption_fold(F.filter("arr", lambda r: r["joins"]), True) if captions else F.array().cast(f"array<{_PICK}>"))
    held = lambda r: F.exists("first", lambda p: p["ri"] == r["ri"])
    whole = lambda t: F.filter("arr", lambda r: (r["ri"] == t["ri"]) | F.exists("first", lambda p: (p["owner"] == t["ri"]) & (p["ri"] == r["ri"])))
    tables = F.transform(F.filter("arr", lambda r: r["tab"] & ~held(r)), lambda t: F.struct(t["ri"].alias("ri"), G.union_bbox(_as_boxes(whole(t))).alias("box")))
    left = F.filter("arr", lambda r: r["note"] & ~held(r))

    def step(acc, t):
        b = G.box_of(t["box"])
        ok = F.filter(left, lambda r: (
            ~F.exists(acc, lambda a: a["ri"] == r["ri"])
            & (r["y0"] - b.y1).between(-V.GEOM_TOL, V.TABLE_NOTE_GAP)
            & (G.h_overlap(b, G.box_of(r)) >= V.TABLE_OVERLAP)))
        best = F.array_min(F.transform(ok, lambda r: F.struct((r["y0"] - b.y1).alias("gap"), r["ri"].alias("ri"))))["ri"]
        return let(best, lambda b: F.when(b.isNotNull(), F.concat(acc, F.array(
            F.struct(b.alias("ri"), t["ri"].alias("owner"), no.alias("panel"), F.lit(0).alias("n"), F.lit(3).alias("step"))))).otherwise(acc).cast(f"array<{_PART}>"))

    second = F.aggregate(tables, F.array().cast(f"array<{_PART}>"), step)
    both = F.transform("first", lambda p: F.struct(p["ri"].alias("ri"), p["owner"].alias("owner"), p["panel"].alias("panel"), p["n"].alias("n"), F.lit(2).alias("step")))
    return g.select(*PAGE_KEY, F.inline(F.concat(both, second) if notes else both)).withColumns({"ospan": F.col("span"), "opage": F.col("page")})


def merge_captions_and_notes_pages(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Figures and tables of a page take their captions, tables then their notes; in one pass over the page."""
    return _apply(rows, _page_picks(rows if texts is None else texts, True, True), texts, PART, _with_captions(notes=True))


def merge_figure_captions_pages(rows: DataFrame) -> DataFrame:
    """Figures and tables of a page take the texts next to them, by ``ri``."""
    return _apply(rows, _page_picks(rows, True, False), None, PART, _with_captions())


def merge_table_notes_pages(rows: DataFrame) -> DataFrame:
    """Each table of a page takes the closest note below it; a note is used once, tables in order."""
    return _apply(rows, _page_picks(rows, False, True), None, PART, _with_captions(notes=True))


def caption_segments(rows: DataFrame, cut: bool = True) -> DataFrame:
    """Runs of figures and caption texts of a document, cut where the fold starts anew whatever came before: doc_id, seg, arr, lead.

    After a caption or source line that is no sub-caption, a figure before it has no place for another figure; nor has a figure on another page. So a figure there
    opens anew. All that comes over the cut is ``lead``, the row just before, and whether another figure has taken it. ``cut`` = False keeps runs whole.
    """
    slim = rows.select(*ROW_KEY, *G.Box._fields, *[c.alias(k) for k, c in _caption_flags(F.col("role").isin("figure", "table")).items()])
    slim = slim.withColumn("joins", F.col("vis") | F.col("sub") | F.col("cap") | F.col("src"))
    hard = ~F.col("vis") & ~F.col("sub") & (F.col("cap") | F.col("src"))
    before = F.struct("ri", "page", (F.col("cap") & ~F.col("vis")).alias("cap"), "y1", hard.alias("hard"), "joins")
    slim = scans.doc_scan(slim, ["page", "ri"], prev=("last", before))
    goes_on = F.coalesce(F.col("prev.joins"), F.lit(False))
    anew = ~goes_on | (F.lit(cut) & F.col("vis") & (F.col("prev.hard") | ((F.col("prev.page") != F.col("page")) & ~F.col("sub"))))
    numbered = scans.doc_scan(slim.withColumn("goes_on", goes_on).withColumn("anew", F.col("joins") & anew), ["page", "ri"], inclusive=True, seg=("sum", F.col("anew").cast("int")))
    lead = F.when(F.col("anew") & F.col("goes_on"), F.struct("prev.ri", "prev.page", "prev.cap", "prev.y1"))
    kept = numbered.where("joins").withColumn("lead", lead).drop("prev", "joins", "goes_on", "anew")
    fields = ["ri"] + [c for c in kept.columns if c not in ("doc_id", "span", "page", "seg", "ri", "lead")]
    return kept.groupBy("doc_id", "seg").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct(*fields))).alias("arr"), F.max("lead").alias("lead"))


def _caption_picks_linear(rows: DataFrame) -> DataFrame:
    """Picks of all segments. A segment is folded for both cases, its lead still free or already taken, and says whether its own last row is
    taken then; running compositions of these small functions tell which case holds, also over very long runs."""
    none = F.array().cast(f"array<{_PICK}>")
    free, taken = (F.col("lead").cast(_NEAR) if case else F.col("lead").withField("cap", F.lit(False)).cast(_NEAR) for case in (True, False))
    some = caption_segments(rows).where(F.exists("arr", lambda r: r["vis"]) & ((F.size("arr") > 1) | F.col("lead").isNotNull()))
    folded = some.withColumn("if_free", _caption_fold(F.col("arr"), False, free))
    decides = F.coalesce(F.col("lead.cap"), F.lit(False)) & F.exists("if_free", lambda p: p["ri"] == F.col("lead.ri"))
    folded = folded.withColumn("if_taken", F.when(decides, _caption_fold(F.col("arr"), False, taken)).otherwise(F.col("if_free")))
    last = F.element_at("arr", -1)["ri"]
    out = {k: F.exists(c, lambda p: p["ri"] == last).cast("int") for k, c in (("o_free", F.col("if_free")), ("o_taken", F.col("if_taken")))}
    folded = folded.select("doc_id", layout.span_of("page").alias("span"), "page", "seg", "if_free", "if_taken", *[c.alias(k) for k, c in out.items()])
    order = ["page", "seg"]
    turned = scans.doc_scan(folded, order, turns=("sum", ((F.col("o_free") == 1) & (F.col("o_taken") == 0)).cast("int")))
    fixed = F.when(F.col("o_free") == F.col("o_taken"), (F.col("o_free") + F.col("turns")) % 2)
    known = scans.doc_scan(turned, order, held=("last", fixed))
    is_taken = (F.coalesce("held", F.lit(0)) + F.col("turns")) % 2 == 1
    picks = known.select("doc_id", F.inline(F.coalesce(F.when(is_taken, F.col("if_taken")).otherwise(F.col("if_free")), none)))
    return picks.select("doc_id", layout.span_of("page").alias("span"), "page", "ri", layout.span_of("opage").alias("ospan"), "opage", "owner", "panel", "n", F.lit(2).alias("step"))


def merge_figure_captions_linear(rows: DataFrame) -> DataFrame:
    """Figures and tables take the texts next to them through the document, also over the end of a page."""
    return _apply(rows, _caption_picks_linear(rows), None, [*PART, "sentences"], _with_captions(spoken=True))


# -- tables ----------------------------------------------------------------------------------------------

_MEMBER = "struct<ri:int,owner:int,n:int>"


def _table_fold(arr) -> F.Column:
    def used(acc, r):
        return F.exists(acc, lambda a: a["ri"] == r["ri"])

    def nearest_note(acc, later, table, taken):
        t = G.box_of(table)
        ok = F.filter(later, lambda r: (
            r["note"] & ~used(acc, r) & ~F.array_contains(taken, r["ri"])
            & (r["y0"] - t.y1).between(-V.GEOM_TOL, V.TABLE_NOTE_GAP)
            & (G.h_overlap(t, G.box_of(r)) >= V.TABLE_OVERLAP)))
        return F.array_min(F.transform(ok, lambda r: F.struct((r["y0"] - t.y1).alias("gap"), r["ri"].alias("ri"))))["ri"]

    def members(ids, owner):
        return F.transform(ids, lambda i, k: F.struct(i.alias("ri"), owner.alias("owner"), k.alias("n")))

    def step(acc, b):
        later = F.filter(arr, lambda r: r["ri"] > b["ri"])

        def labelled(ahead):
            kinds = F.transform(ahead, lambda r: F.when(used(acc, r), 0).when(
                r["tab"] & (r["y1"] >= b["y0"])
                & (G.h_overlap(G.box_of(b), G.box_of(r)) >= V.TABLE_OVERLAP), 2
            ).when(~r["title_like"], 0).otherwise(1))
            at = F.array_position(F.transform(kinds, lambda k: k != 1), True).cast("int")

            def with_table(table):
                ids = F.concat(F.array(b["ri"]), F.transform(F.slice(ahead, 1, F.greatest(at - 1, F.lit(0))), lambda r: r["ri"]),
                               F.array(table["ri"]))
                note = nearest_note(acc, later, table, ids)
                return F.concat(acc, members(F.filter(F.concat(ids, F.array(note)), lambda i: i.isNotNull()), table["ri"]))

            found = (at > 0) & (F.get(kinds, at - 1) == 2)
            return F.when(found, let(F.get(ahead, F.greatest(at - 1, F.lit(0))), with_table)).otherwise(acc)

        def standalone(note):
            return F.when(note.isNotNull(), F.concat(acc, members(F.array(b["ri"], note), b["ri"]))).otherwise(acc)

        return (
            F.when(used(acc, b), acc)
            .when(b["label"], let(F.slice(later, 1, V.TABLE_LOOKAHEAD), labelled))
            .otherwise(let(nearest_note(acc, later, b, F.array(b["ri"])), standalone))
            .cast(f"array<{_MEMBER}>")
        )

    anchors = F.filter(arr, lambda r: r["label"] | r["tab"])
    return F.aggregate(anchors, F.array().cast(f"array<{_MEMBER}>"), step)


def merge_tables_linear(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Label, title lines, table and note of a scattered table become one block. All on one page; only pages with a table and a label or note are gathered."""
    no = F.lit(False)
    flags = {
        "tab": F.coalesce(F.col("role") == "table", no),
        "label": F.coalesce(T.is_table_label("role", "text"), no),
        "note": F.coalesce(T.is_table_note("role", "text"), no),
        "title_like": F.col("role").isin("paragraph", "caption", "section_header")
        & (T.word_count("text") <= V.TABLE_TITLE_WORDS),
    }
    source = rows if texts is None else texts
    slim = source.select(*ROW_KEY, *G.Box._fields, *[c.alias(k) for k, c in flags.items()])
    page = Window.partitionBy(*PAGE_KEY)
    some = slim.withColumn("matters", F.max("tab").over(page) & F.max(F.col("label") | F.col("note")).over(page)).where("matters").drop("matters")
    picks = gather(some, PAGE_KEY).select(*PAGE_KEY, F.inline(_table_fold(F.col("arr")))).withColumns({"ospan": F.col("span"), "opage": F.col("page")})
    others = F.filter("parts", lambda p: p["ri"] != F.col("own_ri"))
    whole = G.union_bbox(_as_boxes(F.col("parts")))
    return _apply(rows, picks, texts, ["n", "ri", *G.Box._fields, "text"], {
        "ri": F.get("parts", F.lit(0))["ri"],
        "text": F.array_join(_texts(F.col("parts")), "\n"),
        "caption_text": F.array_join(F.concat(F.filter(F.array("caption_text"), lambda t: t != ""), _texts(others)), "\n"),
        **{c: whole[c] for c in G.Box._fields},
    })


# -- algorithms ------------------------------------------------------------------------------------------


def merge_algorithms(rows: DataFrame, pages: bool) -> DataFrame:
    """An "Algorithm N" header takes the blocks below it while they stay close and in its column.

    Headers are never taken themselves, so each header opens a region of its own, and the box a block is
    measured against is the running union of its region: windows are enough.
    """
    b, text = G.box(), F.col("text")
    considered = (F.col("kind") == "block") if pages else F.lit(True)
    opener = considered & T.is_algorithm_header("text")
    page = Window.partitionBy(*PAGE_KEY, "considered").orderBy("ri")
    region = Window.partitionBy(*PAGE_KEY, "considered", "region")
    ordered = region.orderBy("ri")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    until = ordered.rowsBetween(Window.unboundedPreceding, 0)
    u = G.Box(F.min("x0").over(earlier), F.min("y0").over(earlier), F.max("x1").over(earlier), F.max("y1").over(earlier))
    marked = (
        rows.withColumn("considered", considered).withColumn("opener", opener)
        .withColumn("starts", F.col("opener") & F.col("role").isin("paragraph", "code", "caption"))
        .withColumn("region", F.sum(F.col("starts").cast("int")).over(page))
        .withColumn("k", F.row_number().over(ordered) - 1)
        .withColumns({f"u_{c}": getattr(u, c) for c in G.Box._fields})
        .withColumn("head_h", F.greatest(F.lit(1.0), F.first(b.y1 - b.y0).over(ordered)))
        .withColumn("bare_label", F.first(T.is_algorithm_label_only("text")).over(ordered))
    )
    run = G.box("u_")
    gap = b.y0 - run.y1
    off_column = G.h_overlap(run, b) < V.ALGORITHM_OVERLAP
    title_row = (
        (F.col("k") == 1) & F.col("bare_label") & F.col("role").isin("paragraph", "caption", "code") & (text != "")
        & (T.word_count("text") <= V.ALGORITHM_TITLE_WORDS)
    )
    walls = F.col("opener") | F.col("role").isin("section_header", "title", "author", *([] if pages else ["figure", "table"]))
    breaks = F.when(F.col("k") == 0, False).when(walls, True).when(F.col("role") == "equation", off_column).when(
        title_row, gap > F.col("head_h") * V.ALGORITHM_TITLE_GAP
    ).otherwise((gap > F.col("head_h") * V.ALGORITHM_GAP) | off_column)
    marked = (
        marked.withColumn("breaks", breaks)
        .withColumn("member", F.col("considered") & (F.col("region") > 0) & ~F.max("breaks").over(until))
        .withColumn("members", F.sum(F.col("member").cast("int")).over(region))
        .withColumn("member", F.col("member") & (F.col("members") > 1))
    )
    part = F.when(F.col("member"), F.struct("ri", "text", "role", "x0", "y0", "x1", "y1"))
    marked = marked.withColumn("parts", F.when(
        F.col("starts"), F.array_sort(F.collect_list(part).over(region)))
    ).where("not member or starts")
    heads = F.col("member")
    second = F.get("parts", F.lit(1))
    whole = G.union_bbox("parts")
    changed = {
        "role": F.when(heads, "algorithm").otherwise(F.col("role")),
        "text": F.when(heads, "" if pages else F.array_join(_texts("parts"), "\n")).otherwise(text),
        "sentences": F.when(heads, F.slice("sentences", 1, 0)).otherwise(F.col("sentences")),
        "footnotes": F.when(heads, F.slice("footnotes", 1, 0)).otherwise(F.col("footnotes")),
        "continuation": F.when(heads, False).otherwise(F.col("continuation")),
        "caption_text": F.when(heads, T.algorithm_caption("text", second["text"], second["role"])).otherwise(F.col("caption_text")),
        "caption_bbox": F.when(heads, F.struct("x0", "y0", "x1", "y1")).otherwise(F.col("caption_bbox")),
        **{c: F.when(heads, whole[c]).otherwise(F.col(c)) for c in G.Box._fields},
    }
    if pages:
        changed["kind"] = F.when(heads, "image").otherwise(F.col("kind"))
    return marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


def drop_decorative_icons(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("role") != "figure") | ~G.is_decorative_icon(G.box(), "caption_text"))
