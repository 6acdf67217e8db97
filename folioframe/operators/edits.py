"""Reader edits as tables: overrides of single blocks and groups of merged blocks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import scans
from folioframe.operators.components import components
from folioframe.sources import layout
from folioframe.sources.layout import PAGE_KEY


def block_key(page="page", ri="ri") -> F.Column:
    return F.concat_ws(":", F.col(page).cast("string"), F.col(ri).cast("string"))


def image_key(page="page", ri="ri") -> F.Column:
    return F.concat(F.lit("img:"), block_key(page, ri))


def paint_key(page="page", x0="x0", y0="y0") -> F.Column:
    """Key of a block that only the linear projection has: page and rounded origin."""
    return F.concat_ws(
        ":", F.lit("L"), F.col(page).cast("string"), T.round_half_up(x0).cast("string"), T.round_half_up(y0).cast("string")
    )


def override_key(kind="kind", page="page", ri="ri", linear_key="linear_key") -> F.Column:
    return F.when(F.col(linear_key).isNotNull(), F.col(linear_key)).when(
        F.col(kind) == "image", image_key(page, ri)
    ).otherwise(block_key(page, ri))


def latest_edit(log: DataFrame, keys: list, value: list, at="edited_at") -> DataFrame:
    """Last write per key."""
    last = F.max_by(F.struct(*value), F.struct(at, "edit_id"))
    return log.groupBy(*keys).agg(last.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in value])


def _role(o_role):
    return F.coalesce(F.when(o_role != "", o_role), F.col("role"))


def _page_of(key) -> F.Column:
    """The page that the key of a block or an image names."""
    return F.expr(f"try_cast(regexp_extract({key}, '^(?:img:)?(-?[0-9]+):-?[0-9]+$', 1) as int)")


def _place(rows: DataFrame) -> list:
    """What rows are dealt out by: their span too, where they have one."""
    return scans.SPAN if "span" in rows.columns else ["doc_id"]


def _placed(few: DataFrame, keys: list, page=None) -> DataFrame:
    """``few`` dealt out as the rows they join are, so that they move and the rows do not; ``page`` says where they belong."""
    if "span" not in keys:
        return few
    if page is not None:
        few = few.withColumn("_page", page).withColumn("span", layout.span_of("_page")).drop("_page")
    return scans.by_span(few)


def apply_overrides_pages(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Role, cut continuation and pin by key; blocks and images have keys of their own."""
    keys = _place(rows)
    o = _placed(overrides.select(
        "doc_id", F.col("key").alias("_key"), F.col("role").alias("o_role"), F.col("continuation").alias("o_cont"),
        F.col("allow_merges").alias("o_allow")), keys, _page_of("_key"))
    is_block = F.col("kind") == "block"
    keyed = rows.withColumn("_key", F.when(is_block, block_key()).otherwise(image_key()))
    out = {
        "role": _role(F.col("o_role")),
        "continuation": F.col("continuation") & ~(is_block & F.coalesce(~F.col("o_cont"), F.lit(False))),
    }
    return keyed.join(o, [*keys, "_key"], "left").select(
        *[out[c].alias(c) if c in out else F.col(c) for c in rows.columns], F.coalesce("o_allow", F.lit(True)).alias("allow_merges"))


def _page_overrides(overrides: DataFrame) -> DataFrame:
    """One row per page with its overrides in the order they were made; overrides of a page are few."""
    fields = ["n", "role", "continuation", "allow_merges", *G.Box._fields]
    return overrides.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ovs"))


def _first_match(box):
    return F.get(F.filter("ovs", lambda o: G.same_object(G.box_of(o), box)), F.lit(0))


def placed_overrides(overrides: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Overrides with a box: their own, or that of the page block their key names."""
    c = [*G.Box._fields]
    own = overrides.where("x0 is not null").select("doc_id", "n", "page", "role", "continuation", "allow_merges", *c)
    keys = _place(page_rows)
    named = _placed(overrides.where("x0 is null").drop(*c, "page"), keys, _page_of("key"))
    by_key = named.join(page_rows.where("kind = 'block'").select(*keys, block_key().alias("key"), "page", *c), [*keys, "key"])
    return own.unionByName(by_key.select(own.columns))


def apply_overrides_linear(linear: DataFrame, overrides: DataFrame, page_rows: DataFrame) -> DataFrame:
    """The first override that covers at least 60 % of a linear block applies to it."""
    keys = _place(linear)
    o = _placed(_page_overrides(placed_overrides(overrides, page_rows)), keys, F.col("page"))
    hit = linear.join(o, [*keys, "page"], "left").withColumn("o", _first_match(G.box()))
    out = {
        "role": _role(F.col("o.role")),
        "continuation": F.col("continuation") & ~F.coalesce(~F.col("o.continuation"), F.lit(False)),
    }
    return hit.select(
        *[out[c].alias(c) if c in out else F.col(c) for c in linear.columns], F.coalesce("o.allow_merges", F.lit(True)).alias("allow_merges"))


def apply_overrides_metadata(metadata: DataFrame, overrides: DataFrame) -> DataFrame:
    """Left-out text starts as ignored; only overrides that carry a box re-type it."""
    keys = _place(metadata)
    o = _placed(_page_overrides(overrides.where("x0 is not null")), keys, F.col("page"))
    hit = metadata.join(o, [*keys, "page"], "left").withColumn("o", _first_match(G.box()))
    return hit.select(*metadata.columns, F.coalesce(F.when(F.col("o.role") != "", F.col("o.role")), F.lit("ignored")).alias("role"))


def inject_linear_only(page_rows: DataFrame, linear: DataFrame, metadata: DataFrame, pages: DataFrame) -> DataFrame:
    """Append explainable blocks that no page block or image stands for."""
    fields = [*PAGE_KEY, "role", "text", *G.Box._fields, "sentences"]
    source = linear.select(*fields, "footnotes", "allow_merges").unionByName(
        metadata.select(*fields), allowMissingColumns=True)
    wanted = source.where(T.explainable("role", F.size("sentences"))).join(
        _placed(pages.select("doc_id", "page"), scans.SPAN, F.col("page")), PAGE_KEY, "left_semi")
    a, b = wanted.alias("a"), page_rows.select(*PAGE_KEY, *G.Box._fields).alias("b")
    cond = G.same_object(G.box("a."), G.box("b."))
    for k in PAGE_KEY:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    extra = a.join(b, cond, "left_anti").select(
        *fields, "footnotes", "allow_merges", F.lit("block").alias("kind"), F.lit(False).alias("continuation"),
        F.lit(True).alias("injected"), paint_key().alias("linear_key"))
    native = page_rows.withColumns({"injected": F.lit(False), "linear_key": F.lit(None).cast("string")})
    return native.unionByName(extra, allowMissingColumns=True)


def merge_group_members(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Resolve the members of merge groups: one box, captions of a visual group, texts and footnotes else.

    ``groups``: doc_id, group_id, result_role, member_no, kind, page, ri, linear_key.
    """
    key = lambda: override_key()
    m = groups.withColumn("_key", key()).select("doc_id", "group_id", "result_role", "member_no", "_key")
    r = rows.withColumn("_key", key()).select("doc_id", "_key", "kind", "page", "role", "text", "caption_text", "sentences", *G.Box._fields)
    said = F.when(F.col("kind") == "image", F.col("caption_text")).otherwise(F.col("text"))
    found = m.join(r, ["doc_id", "_key"]).withColumn("said", F.coalesce(said, F.lit("")))
    part = F.struct("member_no", "kind", "page", "role", "said", F.col("text"), F.size("sentences").alias("n"))
    visual = F.col("result_role").isin("table", "figure", "algorithm")
    joined = lambda parts, f, sep: F.array_join(F.filter(F.transform(parts, lambda p: p[f]), lambda t: t != ""), sep)
    notes = F.filter("parts", lambda p: p["role"] == "footnote")
    prose = F.filter("parts", lambda p: p["role"] != "footnote")
    images = F.filter("parts", lambda p: p["kind"] == "image")
    return (
        found.groupBy("doc_id", "group_id", "result_role")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
             F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        .select(
            "doc_id", "group_id", "result_role", F.size("parts").alias("members"),
            F.coalesce(F.get(images, F.lit(0))["page"], F.get("parts", F.lit(0))["page"]).alias("page"), *G.Box._fields,
            F.when(visual, joined(F.col("parts"), "said", "\n")).otherwise(joined(prose, "text", "\n\n")).alias("text"),
            F.when(visual, "").otherwise(joined(notes, "text", "\n")).alias("footnotes"),
        )
    )


_MEMBER = "struct<key:string,kind:string,page:int,role:string>"
_GROUP = f"struct<id:string,members:array<{_MEMBER}>,role:string,at:bigint>"


def _stem(key) -> F.Column:
    """A key without its marks, as the names of groups hold it."""
    return F.regexp_replace(key, r"[^A-Za-z0-9_]", "")


def edit_components(log: DataFrame) -> DataFrame:
    """``log`` with ``comp``: edits of a document that cannot touch each other's groups have different ones.

    Edits are linked when they name a common member; members with one stem count as one, since the names of groups hold no more.
    Edits without members change nothing and are left out.
    """
    node = lambda m: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), _stem(m["key"]))
    named = log.where(F.size("members") > 0).withColumn("_node", node(F.get("members", F.lit(0))))
    links = named.select(F.col("_node").alias("a"), F.explode(F.transform("members", node)).alias("b")).distinct()
    comp = components(links).withColumnRenamed("node", "_node")
    return named.join(comp, "_node").drop("_node")


def replay_merge_groups(log: DataFrame) -> DataFrame:
    """Groups of each document after its edit log: doc_id, edit_id, op ("merge" or "cut"), members.

    A merge extends the groups it touches, which fuse under the id of the first; a cut takes its member
    out of its group. A group of fewer than two members dissolves. ``n`` is the place of a group in its document: by its latest edit.
    The log is replayed by component of edits that touch each other, so a long log of one document spreads over many tasks.
    """
    none = F.expr("array()").cast(f"array<{_GROUP}>")

    def result_role(ms):
        roles = F.transform(ms, lambda m: F.coalesce(m["role"], F.when(m["kind"] == "image", "figure").otherwise("paragraph")))
        return T.resolve_merged_role(roles)

    def step(acc, e):
        picked = F.transform(e["members"], lambda m: m["key"])
        touched = F.filter(acc, lambda g: F.exists(g["members"], lambda m: F.array_contains(picked, m["key"])))
        rest = F.filter(acc, lambda g: ~F.exists(g["members"], lambda m: F.array_contains(picked, m["key"])))
        pool = F.concat(F.flatten(F.transform(touched, lambda g: g["members"])), e["members"])
        keys = F.transform(pool, lambda m: m["key"])
        members = F.filter(F.transform(pool, lambda m, i: F.when(F.array_position(keys, m["key"]) == i + 1, m)), lambda m: m.isNotNull())
        stems = F.transform(members, lambda m: _stem(m["key"]))
        fresh = F.concat(F.lit("mg-"), F.get(e["members"], F.lit(0))["page"].cast("string"), F.lit("-"), F.array_join(stems, "-"))
        gid = F.coalesce(F.get(touched, F.lit(0))["id"], fresh)
        group = F.struct(gid.alias("id"), members.alias("members"), result_role(members).alias("role"), e["edit_id"].alias("at"))
        merged = F.concat(F.filter(rest, lambda g: g["id"] != gid), F.array(group))
        grown = F.when((F.size(e["members"]) < 2) | (F.size(members) < 2), acc).otherwise(merged)
        hit = F.get(touched, F.lit(0))
        remaining = F.filter(hit["members"], lambda m: ~F.array_contains(picked, m["key"]))
        others = F.filter(acc, lambda g: g["id"] != hit["id"])
        kept = F.concat(others, F.array(F.struct(hit["id"].alias("id"), remaining.alias("members"), hit["role"].alias("role"), e["edit_id"].alias("at"))))
        cut = F.when(F.size(touched) == 0, acc).when(F.size(remaining) >= 2, kept).otherwise(others)
        return F.when(e["op"] == "merge", grown).otherwise(cut).cast(f"array<{_GROUP}>")

    g = edit_components(log).groupBy("doc_id", "comp").agg(F.array_sort(F.collect_list(F.struct("edit_id", "op", "members"))).alias("log"))
    groups = g.select("doc_id", F.explode(F.aggregate("log", none, step)).alias("g"))
    place = Window.partitionBy("doc_id").orderBy("g.at")
    return groups.select(
        "doc_id", (F.row_number().over(place) - 1).alias("n"), F.col("g.id").alias("group_id"), F.col("g.members").alias("members"), F.col("g.role").alias("result_role"))
