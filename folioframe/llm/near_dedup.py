"""Near duplicates by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with its occurrence number. One entry of
the sketch takes the two k-mers with the smallest hashes and keeps them in text order, so equal
entries speak for equal order and not only for equal content. Bands of entries make the candidates;
alignment of the k-mer sequences inside the band that the threshold allows decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import drop, mix, stage, word_hashes

K = 5
ENTRIES, ROWS = 48, 2
_SEED = (mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint32)
_TOP = np.iinfo(np.uint32).max
_STEP = 2048
BINS = 128


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Hashes of the runs of ``k`` words, in text order; a text of fewer words is one run, a text without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + words[i : i + len(h)]
    return mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """The same with the occurrence number of each value mixed in, so that all are different."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, dtype=bool)
    if new.all():
        return h
    first = np.flatnonzero(new)
    count = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = h.copy()
    out[order] = np.where(count > 0, mix(s + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s)
    return out


def sketch(marks: np.ndarray) -> np.ndarray:
    """Order MinHash of labelled k-mers: ``ENTRIES`` hashes, each of the two smallest k-mers in text order."""
    low = np.full((ENTRIES, 2), _TOP, dtype=np.uint32)  # the two smallest values so far
    at = np.zeros((ENTRIES, 2), dtype=np.int64)
    rows = np.arange(ENTRIES)
    short = (marks >> np.uint64(32)).astype(np.uint32)
    for begin in range(0, len(short), _STEP):
        h = short[None, begin : begin + _STEP] * _SEED[:, None]
        for _ in range(min(2, h.shape[1])):
            i = h.argmin(axis=1)
            v = h[rows, i]
            better = v < low[:, 1]
            low[better, 1], at[better, 1] = v[better], i[better] + begin
            swap = low[:, 1] < low[:, 0]
            low[swap], at[swap] = low[swap][:, ::-1], at[swap][:, ::-1]
            h[rows, i] = _TOP
    first, second = marks[at.min(axis=1)], marks[at.max(axis=1)]
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second + np.uint64(7)))


def bands(text: str | None) -> tuple[int, np.ndarray]:
    """The number of k-mers of a text, and its band keys (none without words)."""
    h = shingles(text)
    if not len(h):
        return 0, np.empty(0, dtype=np.int64)
    entry = sketch(labelled(h)).reshape(-1, ROWS)
    key = np.arange(len(entry), dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + entry[:, j])
    return len(h), key.view(np.int64)


def _chain(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int]:
    """Of two sequences without repeats: how many values they share, and the longest chain of them in the order of both, inside the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = len(i)
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    ends: list[int] = []
    for y in j[near][order].tolist():
        at = bisect_left(ends, y)
        if at == len(ends):
            ends.append(y)
        else:
            ends[at] = y
    return shared, len(ends)


def _frontier(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The least number of insertions and deletions that turn ``a`` into ``b``, if it is ``most`` at most.

    Diagonals advance together, as far as they match; memory is the width of the band, not the length of the texts.
    """
    n, m = len(a), len(b)
    diag = np.arange(-most - 1, most + 2)
    reach = np.full(len(diag), -1, dtype=np.int64)  # how far into ``a`` each diagonal (place in b less place in a) has come
    mid = most + 1
    for e in range(most + 1):
        if e == 0:
            reach[mid] = 0
        else:
            lo, hi = mid - e, mid + e + 1
            new = np.maximum(np.where(reach[lo - 1 : hi - 1] >= 0, reach[lo - 1 : hi - 1], -1) if lo else -1,
                             np.where(reach[lo + 1 : hi + 1] >= 0, reach[lo + 1 : hi + 1] + 1, -1))
            new = np.maximum(new, reach[lo:hi])
            d = diag[lo:hi]
            reach[lo:hi] = np.where((new <= n) & (new + d <= m) & (new + d >= 0), new, -1)
        live = np.flatnonzero(reach >= 0)
        while len(live):
            x = reach[live]
            y = x + diag[live]
            inside = (x < n) & (y < m)
            live, x, y = live[inside], x[inside], y[inside]
            same = a[x] == b[y]
            live = live[same]
            reach[live] += 1
        end = mid + m - n
        if 0 <= end < len(reach) and reach[end] >= n:
            return e
    return None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the k-mer sequences ``a`` and ``b`` share enough in one order: common / (all - common) >= ``similarity``.

    ``common`` is the length of the best alignment. A threshold bounds the insertions and deletions, and so the band.
    """
    if not len(a) or not len(b):
        return False
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    most = total - 2 * need
    if min(len(a), len(b)) < need:
        return False
    # Numbered occurrences make all values different, so the chain is found in one pass; it is a true alignment.
    shared, chain = _chain(labelled(a), labelled(b), most)
    if chain >= need:
        return True
    if shared < need:
        return False  # no alignment has more than the shared occurrences
    moves = _frontier(a, b, most)
    return moves is not None and moves <= most


def _sketches(docs: DataFrame) -> DataFrame:
    """Stage table of all rows: rid, doc_id, text_hash, key (digest of the text), n (k-mers), bands."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.unhex(F.md5("text")).alias("key"), "text")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            found = [bands(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_hash", "key")), pa.array([max(0, n) for n, _ in found], pa.int64()),
                 pa.array([b for _, b in found], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "n", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, key binary, n long, bands array<long>")
    return stage(made.select(F.monotonically_increasing_id().alias("rid"), "*"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stage table uid, text of the ``wanted`` (uid, key) texts, each once.

    A bitmap of fixed size drops most other texts before they move; where it is too full it only drops fewer.
    """
    bits = 24
    at = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    # At most 2**18 rows, whatever the corpus: small enough to broadcast.
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    bitmap = wanted.withColumn("at", at).select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
    rows = docs.select(F.unhex(F.md5("text")).alias("key"), "text").where("text is not null").withColumn("at", at)
    some = rows.join(F.broadcast(bitmap), F.shiftright("at", 6) == F.col("word")).where(F.getbit("held", F.col("at") % 64) == 1).select("key", "text")
    return stage(some.dropDuplicates(["key"]).join(wanted, "key").select("uid", "text"))


def _profiles(texts: DataFrame) -> DataFrame:
    """uid, n (k-mers) and shared: how many k-mers that another of these texts has too fall into each of ``BINS`` bins.

    Two texts have no more in common than the sums of the smaller counts of their bins. Different k-mers with one hash count as
    shared, which only raises the sums, so the bound holds.
    """
    def run(batches):
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                marks = labelled(shingles(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), uid)), pa.array(marks)], names=["uid", "mark"])

    def total(batches):
        for batch in batches:
            bins = [np.bincount(labelled(shingles(t)).astype(np.int64) & (BINS - 1), minlength=BINS) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([b.tolist() for b in bins], pa.list_(pa.int32()))], names=["uid", "bins"])

    once = texts.mapInArrow(run, "uid long, mark long").groupBy("mark").agg(F.count("*").alias("n"), F.min("uid").alias("uid")).where("n = 1")
    own = once.groupBy("uid").agg(F.collect_list(F.col("mark").bitwiseAND(BINS - 1).cast("int")).alias("own"))
    every = texts.mapInArrow(total, "uid long, bins array<int>").join(own, "uid", "left")

    def less(batches):
        for batch in batches:
            bins = np.array(batch.column("bins").to_pylist(), dtype=np.int64).reshape(-1, BINS)
            n = bins.sum(axis=1)
            left = [b - np.bincount(o, minlength=BINS) if o else b for b, o in zip(bins, batch.column("own").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(n), pa.array([x.tolist() for x in left], pa.list_(pa.int32()))], names=["uid", "n", "shared"])

    found = every.mapInArrow(less, "uid long, n long, shared array<int>")
    return found.withColumn("s", F.aggregate("shared", F.lit(0).cast("long"), lambda x, y: x + y))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, and what else they hold: from, to) whose texts are alike."""
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "from", "to", "text_a", "text_b")

    def run(batches):
        held: OrderedDict = OrderedDict()

        def of(uid, text):
            if uid not in held:
                held[uid] = shingles(text)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[uid]

        for batch in batches:
            columns = [batch.column(c) for c in ("a", "b", "text_a", "text_b")]
            good = [alike(of(a.as_py(), s.as_py()), of(b.as_py(), t.as_py()), similarity) for a, b, s, t in zip(*columns)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b", "from", "to")], names=["a", "b", "from", "to"])

    return both.mapInArrow(run, "a long, b long, `from` long, `to` long")


def components(links: DataFrame) -> DataFrame:
    """Stage table uid, comp: the smallest uid that links (a, b) reach, without a driver-side graph.

    Each turn takes the smallest component among the neighbours and then jumps to that one's component, so
    long chains shorten by half or more; turns end when nothing changes.
    """
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = edges.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.col("uid")).alias("comp"))
    before = None
    while True:
        near = edges.join(state.select(F.col("uid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("comp").alias("near"))
        least = state.join(near, "uid").select("uid", "comp", F.least("comp", "near").alias("least"))
        jump = least.select(F.col("uid").alias("least"), F.col("least").alias("far"))
        state = stage(least.join(jump, "least").select("uid", F.col("far").alias("comp"), F.col("comp").alias("old")))
        if before is not None:
            drop(before)
        before = state
        if state.where("comp != old").isEmpty():
            drop(edges)
            return state.select("uid", "comp")
        state = state.select("uid", "comp")


def _common(x: str, y: str) -> Column:
    """An upper bound on the k-mers that two profiles have in common."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.least(u, v)), F.lit(0).cast("long"), lambda t, v: t + v)


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; further columns are ignored), a row for each row.

    Texts are linked when their sequences of five-word k-mers align to a similarity of 0.8 or more;
    classes are the connected texts. Returns doc_id, text_hash, class_id (the smallest doc_id of the class), class_size,
    kept (true for one row of each class, that with the smallest doc_id; null comes last).
    Equal texts are one class, also without words; apart from that, a text without words has no links. A null
    text is a class of its own. An empty table gives an empty result.
    """
    rows = _sketches(docs)
    unique = stage(rows.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).select(
        F.monotonically_increasing_id().alias("uid"), "*"))
    comp = _links(docs, unique, similarity)
    known = unique.select("key", "uid").join(comp, "uid", "left").select("key", F.coalesce("comp", "uid").alias("comp"))
    placed = rows.select("rid", "doc_id", "text_hash", "key").join(known, "key", "left")
    placed = stage(placed.select("rid", "doc_id", "text_hash", F.coalesce(F.col("comp"), -F.col("rid") - 1).alias("comp")))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("r"))
    groups = placed.groupBy("comp").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    return placed.join(groups, "comp").select("doc_id", "text_hash", F.col("first.id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.r")).alias("kept"))


# Bands that elect leaders together: copies meet in the first ones, and only texts that are still apart go on to the many others.
FIRST_BANDS = ((0, 1), (1, 3), (3, 7), (7, ENTRIES // ROWS))


def _links(docs: DataFrame, unique: DataFrame, similarity: float, leaders: int = 512) -> DataFrame:
    """uid, comp for the texts that have links.

    First every bucket compares its texts with one leader, some bands at a time; a text meets a leader only if it is not of its
    component yet. From then on, buckets whose texts are not all of one component compare across components: first a quarter of the
    buckets, since texts that are alike meet in many, and then all of them. The texts outside the largest component of a bucket take turns as leaders,
    about ``leaders`` of a bucket at a time, until each has been one. Of two texts of different components one at least is outside the largest, so
    no candidate pair is left out.
    """
    each = unique.select("uid", F.posexplode("bands").alias("at", "band"))
    several = each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    members = stage(each.join(several, "band"))
    texts = _texts(docs, unique.select("uid", "key").join(members.select("uid").distinct(), "uid"))
    # A text that has too many k-mers of its own for even the shortest text of a bucket can have no link there.
    placed = members.join(_profiles(texts), "uid").where(F.col("s") >= F.col("n") * similarity - 1e-6)
    shortest = placed.groupBy("band").agg(F.min("n").alias("least"))
    placed = placed.join(shortest, "band").where(F.col("s") * (1 + similarity) >= (F.col("n") + F.col("least")) * similarity - 1e-6).drop("least")
    active = stage(placed.withColumn("comp", F.col("uid")))
    drop(members)
    moved = unique.limit(0).select("uid", F.col("uid").alias("comp"))
    # The first leader is the text that shares most: most others are like it.
    order = F.struct(((F.col("n") - F.col("s")) * 1000 / F.col("n")).cast("int").alias("own"), F.col("uid").alias("uid"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("shared").alias("theirs"), F.col("comp").alias("comp"))
    one = lambda rows: rows.groupBy("band").agg(F.min(order).alias("x")).select(
        F.col("band").alias("lead_band"), F.col("x.uid").alias("lead"), F.col("x.comp").alias("lead_comp"), "x.m", "x.t", "x.theirs")
    several_of = lambda rows: rows.where("outside").select(
        F.col("band").alias("lead_band"), F.col("uid").alias("lead"), F.col("comp").alias("lead_comp"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("shared").alias("theirs"))

    def turn(some: DataFrame, lead: DataFrame, keep) -> None:
        """Compare ``some`` with ``lead``, join components, and go on with the buckets that ``keep`` leaves."""
        nonlocal active, moved
        need = (F.col("n") + F.col("m")) * similarity - 1e-6
        able = (F.least("s", "t") * (1 + similarity) >= need) & (_common("shared", "theirs") * (1 + similarity) >= need)
        met = some.join(lead, (F.col("band") == F.col("lead_band")) & (F.col("comp") != F.col("lead_comp")) & able)
        ends = F.when(F.col("uid") < F.col("lead"), F.struct(F.col("uid").alias("a"), F.col("lead").alias("b"), F.col("comp").alias("from"), F.col("lead_comp").alias("to"))).otherwise(
            F.struct(F.col("lead").alias("a"), F.col("uid").alias("b"), F.col("lead_comp").alias("from"), F.col("comp").alias("to")))
        pairs = stage(met.select(ends.alias("p")).distinct().select("p.*"))
        links = None if pairs.isEmpty() else stage(_verified(pairs, texts, similarity))
        now = active
        if links is not None and not links.isEmpty():
            # Links join components; what had a component keeps it under the new name.
            comp = components(links.select(F.col("from").alias("a"), F.col("to").alias("b")))
            renamed = comp.select(F.col("uid").alias("comp"), F.col("comp").alias("new"))
            known = moved.join(renamed, "comp", "left").select("uid", F.coalesce("new", "comp").alias("comp"))
            moved = stage(known.unionByName(comp.join(moved.select("uid"), "uid", "left_anti")))
            now = now.join(renamed, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
        state = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("turns").alias("turns") if "turns" in now.columns else F.lit(0).alias("turns"))
        now = stage(now.join(state.where(F.col("lo") < F.col("hi")).where(keep).select("band"), "band"))
        for df in (active, pairs, *([links] if links is not None else [])):
            drop(df)
        active = now

    for lo, hi in FIRST_BANDS:
        if active.isEmpty():
            return moved
        some = active.where(F.col("at").between(lo, hi - 1))
        turn(some, one(some), F.lit(True))
    if active.isEmpty():
        return moved
    # Fixed from here on, so that the leaders of all turns together are the texts outside one component of their bucket.
    largest = active.groupBy("band", "comp").agg(F.count("*").alias("size")).groupBy("band").agg(
        F.max_by("comp", F.struct("size", "comp")).alias("most"), (F.sum("size") - F.max("size")).alias("rest"))
    outside = active.join(largest, "band").select(*active.columns, (F.col("comp") != F.col("most")).alias("outside"), F.ceil(F.col("rest") / leaders).cast("long").alias("turns"))
    before, active = active, stage(outside)
    drop(before)
    now = lambda rows, k: rows.where(F.pmod(F.xxhash64("uid"), F.col("turns")) == k)
    some = active.where(F.pmod(F.xxhash64("band"), F.lit(4)) == 0)
    turn(some, several_of(now(some, 0)), F.lit(True))
    k = 0
    while not active.isEmpty():
        turn(active, several_of(now(active, k)), F.col("turns") > k + 1)
        k += 1
    return moved


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``near_classes`` without the text hash: doc_id, class_id, class_size, kept."""
    return near_classes(docs, **options).drop("text_hash")
