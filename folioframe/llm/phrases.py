"""Phrase collocations by vertical partitioning of a suffix tree over words, cut off at four words.

The suffixes of all pieces of text form one tree; its nodes are the phrases, and the leaves below a node count how often
its phrase occurs. The tree is cut into groups of word prefixes, each with about as many leaves as a memory budget allows:
prefixes of one word are packed together, and a prefix with more leaves than the budget is prolonged by its
next word, up to four. A task then builds the subtree of its group alone: it sorts the leaves, sums equal
ones, and reads the totals of the inner nodes off the sorted list.

Leaves travel as blocks, one per group and about a million words of text; equal suffixes of a block are one leaf
with a count. A phrase cannot be frequent with a rare word in it, so leaves end before rare words.
Words travel as numbers of a dictionary of bounded size; words beyond it are spelled out in the block.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import drop, mix, stage

DEPTH, LEAST, TOP = 4, 30, 2000
DICTIONARY = 1 << 18  # words with a number
BUDGET = 1 << 21  # leaves of a group
GROUPS = 1 << 16  # no more prefixes than this are prolonged per depth, so their list stays small
BUFFER = 1 << 20  # words of text per block
STRETCH = 1 << 20  # bytes of text that are words at one time
_BITS = 20

_FOLD = bytes(10 if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def pieces(raw: bytes):
    """The words of a text in lists of bounded size, with a line feed for each end of a piece, and empty ones to skip."""
    line = raw.translate(_FOLD).replace(b"\n", b" \n ")
    begin = 0
    while begin < len(line):
        end = line.find(b" ", begin + STRETCH) if len(line) - begin > STRETCH else -1
        end = len(line) if end < 0 else end
        yield line[begin:end].split(b" ")
        begin = end


def _word_counts(rows: DataFrame) -> DataFrame:
    """Stage table lang, word, n of ``rows`` (lang, raw)."""
    def run(batches):
        held: dict[str, dict[bytes, int]] = {}

        def out():
            for lang, counts in held.items():
                counts.pop(b"", None), counts.pop(b"\n", None)
                words = list(counts)
                for i in range(0, len(words), 50_000):
                    some = words[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist()):
                counts = held.setdefault(lang, {})
                get = counts.get
                for words in pieces(raw):
                    for w in words:
                        counts[w] = get(w, 0) + 1
                    if len(counts) > 1 << 19:
                        yield from out()
                        counts = held.setdefault(lang, {})
                        get = counts.get
            if sum(map(len, held.values())) > 1 << 19:
                yield from out()
        yield from out()

    return stage(rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


@dataclass
class Coder:
    """Numbers of words, and the group of each prefix.

    ``words`` holds (lang, word) by number, from 1; 0 ends a suffix. ``complete``: words without a number are rare. ``heavy`` holds, for prefixes of 1, 2 and 3 words
    with more leaves than the budget: their sorted keys, their first group and how many groups they have.
    """

    words: list
    group: np.ndarray
    spelled: tuple[int, int]
    complete: bool
    heavy: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    total: int = 0

    def __post_init__(self):
        self.hash = mix(np.arange(len(self.words) + 1, dtype=np.uint64) + np.uint64(1))
        self.number: dict[str, dict[bytes, int]] = {}

    def prepare(self):
        """The lookup of each language; made where the texts are."""
        if not self.number:
            for i, (lang, word) in enumerate(self.words):
                self.number.setdefault(lang, {b"": -1, b"\n": 0})[word] = i + 1
        return self

    def prolong(self, keys: np.ndarray, counts: np.ndarray, budget: int):
        """Give the heavy prefixes of the next depth their own groups."""
        order = np.argsort(keys)
        n = -(-counts[order] // budget)
        self.starts.append(self.total)
        self.heavy.append((keys[order], self.total + np.cumsum(n) - n, n))
        self.total += int(n.sum())

    def encode(self, lang: str, raw: bytes, extra: dict) -> list[np.ndarray]:
        number = self.number.get(lang) or {b"": -1, b"\n": 0}
        out = []
        for words in pieces(raw):
            ids = np.fromiter(map(number.get, words, repeat(-2)), dtype=np.int64, count=len(words))
            unknown = np.flatnonzero(ids == -2)
            if self.complete:
                ids[unknown] = 0
            else:
                for i in unknown.tolist():
                    ids[i] = extra.setdefault((lang, words[i]), len(self.words) + 1 + len(extra))
            out.append(ids[ids >= 0])
        out.append(np.zeros(1, dtype=np.int64))
        return out

    def is_heavy(self, depth: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows start with a heavy prefix of ``depth`` words, and the place of that prefix."""
        keys = self.heavy[depth - 1][0]
        key = np.zeros(len(w), dtype=np.int64)
        for d in range(depth):
            key = key << _BITS | w[:, d]
        known = (w[:, :depth] <= len(self.words)).all(axis=1)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        return (known & (keys[at] == key) if len(keys) else np.zeros(len(w), dtype=bool)), at

    def groups(self, w: np.ndarray, extra_hash: np.ndarray) -> np.ndarray:
        """The group of each row of ``w``: suffixes of up to four words."""
        first, many = self.spelled
        of_word = np.concatenate((self.group, first + (extra_hash % np.uint64(max(1, many))).astype(np.int64)))
        hashes = np.concatenate((self.hash, extra_hash))
        g = of_word[w[:, 0]]
        for depth, (_, start, n) in enumerate(self.heavy, 1):
            hit, at = self.is_heavy(depth, w)
            if hit.any():
                g[hit] = start[at[hit]] + (hashes[w[hit, depth]] % n[at[hit]].astype(np.uint64)).astype(np.int64)
        return g


def _suffixes(ids: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes of two words and more, cut off at ``depth`` words, sorted, and how often each occurs."""
    line = np.concatenate((ids, np.zeros(depth, dtype=np.int64)))
    w = np.stack([line[d : d + len(ids)] for d in range(depth)], axis=1)
    w = w[(w[:, 0] > 0) & (w[:, 1] > 0)]
    for d in range(2, depth):
        w[w[:, d - 1] == 0, d] = 0
    return merged(w, np.ones(len(w), dtype=np.int64))


def merged(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted, equal ones together with their counts summed."""
    if not len(w):
        return w, n
    keys = []
    for d in range(0, w.shape[1], 2):
        pair = w[:, d].astype(np.uint64) << np.uint64(32)
        keys.append(pair | w[:, d + 1].astype(np.uint64) if d + 1 < w.shape[1] else pair)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(w), dtype=bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return w[order[at]], np.add.reduceat(n[order], at)


def _buffers(batches, coder: Coder, buffer: int):
    """Texts as numbers, about ``buffer`` words at a time, and the spelled words among them."""
    coder.prepare()
    held, size, extra = [], 0, {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist()):
            for ids in coder.encode(lang, raw, extra):
                held.append(ids)
                size += len(ids)
            if size >= buffer:
                yield np.concatenate(held), extra
                held, size, extra = [], 0, {}
    if size:
        yield np.concatenate(held), extra


def _longer(rows: DataFrame, coder: Coder, depth: int, budget: int, buffer: int) -> list:
    """The prefixes of ``depth`` words with more leaves than the budget; all start with a heavy one of ``depth - 1`` words."""
    names = [f"w{d}" for d in range(depth)]

    def run(batches):
        for ids, _ in _buffers(batches, coder, buffer):
            w, n = _suffixes(ids, depth)
            # Neither does a spelled word, which is rarer than those with a number, have so many leaves.
            good = (w[:, -1] > 0) & (w[:, -1] <= len(coder.words)) & coder.is_heavy(depth - 1, w)[0]
            if good.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(w[good, d]) for d in range(depth)), pa.array(n[good])], names=[*names, "n"])

    counts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "n"))).groupBy(*names).agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > budget).collect()  # at most (all words) / budget rows


def _packed(w: np.ndarray, n: np.ndarray) -> bytes:
    """Leaves of a block: columns of 32-bit numbers, then 64-bit counts, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(w.T.astype("<u4").tobytes() + n.astype("<i8").tobytes())


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = len(raw) // (4 * DEPTH + 8)
    return np.frombuffer(raw, "<u4", n * DEPTH).reshape(DEPTH, n).T.astype(np.int64), np.frombuffer(raw, "<i8", n, 4 * DEPTH * n)


_SPELLED = "array<struct<lang:string,word:binary>>"


def _leaf_blocks(rows: DataFrame, coder: Coder, buffer: int) -> DataFrame:
    """group, leaves, spelled: the leaves of each group in about ``buffer`` words of text."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.binary())]))

    def run(batches):
        for ids, extra in _buffers(batches, coder, buffer):
            w, n = _suffixes(ids)
            if not len(w):
                continue
            names = list(extra)
            g = coder.groups(w, np.array([zlib.crc32(word, zlib.crc32(lang.encode())) for lang, word in names], dtype=np.uint64))
            order = np.argsort(g, kind="stable")
            cuts = np.flatnonzero(np.diff(g[order])) + 1
            base = len(coder.words)
            for part in np.split(order, cuts):
                own, spelled = w[part], []
                used = np.unique(own[own > base])
                if len(used):
                    own = np.where(own > base, base + 1 + np.searchsorted(used, own), own)
                    spelled = [{"lang": names[i][0], "word": names[i][1]} for i in (used - base - 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([g[part[0]]], pa.int64()), pa.array([_packed(own, n[part])], pa.binary()), pa.array([spelled], kind)], names=["group", "leaves", "spelled"])

    return rows.mapInArrow(run, f"`group` long, leaves binary, spelled {_SPELLED}")


def frequent_nodes(w: np.ndarray, n: np.ndarray, shallow: int, least: int):
    """The inner nodes and leaves of the subtree over sorted, different suffixes ``w``: rows and totals by depth, from ``shallow`` on."""
    for depth in range(shallow, w.shape[1] + 1):
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:, :depth] != w[:-1, :depth]).any(axis=1)
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at)
        good = (w[at, depth - 1] > 0) & (total >= least)
        yield w[at[good], :depth], total[good]


def _subtrees(blocks: DataFrame, coder: Coder, least: int) -> DataFrame:
    """lang, phrase, m (its words), a (how often it occurs) for the frequent phrases of two words and more below the prefixes of each group."""
    deep = [(s, d) for d, s in enumerate(coder.starts, 1)]
    base, names = len(coder.words), coder.words

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        shallow = max([2, *(d + 1 for s, d in deep if group >= s)])
        numbers: dict = {}
        parts = []
        for block, spelled in zip(table.column("leaves").to_pylist(), table.column("spelled").to_pylist()):
            w, n = _unpacked(block)
            if spelled:
                to = np.array([base + 1 + numbers.setdefault((s["lang"], s["word"]), len(numbers)) for s in spelled])
                w = np.where(w > base, to[np.maximum(w - base - 1, 0)], w)
            parts.append((w, n))
        w, n = merged(np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
        del parts
        extra = list(numbers)
        word = lambda i: names[i - 1] if i <= base else extra[i - base - 1]
        lang, phrase, m, a = [], [], [], []
        for nodes, total in frequent_nodes(w, n, shallow, least):
            for row in nodes.tolist():
                lang.append(word(row[0])[0])
                phrase.append(b" ".join(word(i)[1] for i in row))
                m.append(len(row))
            a += total.tolist()
        return pa.table([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(m, pa.int32()), pa.array(a, pa.int64())], names=["lang", "phrase", "m", "a"])

    return blocks.groupBy("group").applyInArrow(run, "lang string, phrase binary, m int, a long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, dictionary: int = DICTIONARY, budget: int = BUDGET, buffer: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """Stage tables: words (lang, word, n), all of them; and phrases (lang, phrase, m, a), those of two to four words that occur ``least`` times or more.

    Words and phrases are bytes.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    words = _word_counts(rows)
    often = words.where(F.col("n") >= least)
    size, leaves = often.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    dictionary = min(dictionary, (1 << _BITS) - 1)
    held = often.orderBy(F.desc("n"), "lang", "word").limit(dictionary).toArrow()  # at most ``dictionary`` rows
    counts = np.array(held.column("n").to_pylist(), dtype=np.int64)
    budget = max(budget, -(-leaves // GROUPS))
    coder = Coder(list(zip(held.column("lang").to_pylist(), held.column("word").to_pylist())), np.zeros(1, dtype=np.int64), (0, 0), size <= dictionary)
    # Light words share groups in the order of their numbers; heavy ones get groups of their own.
    light = np.where(counts > budget, 0, counts)
    coder.group = np.concatenate(([0], (np.cumsum(light) - light) // budget)).astype(np.int64)
    rest = leaves - int(counts.sum())
    first = int(coder.group.max()) + 1
    coder.spelled = (first, -(-rest // budget))
    coder.total = first + coder.spelled[1]
    heavy = np.flatnonzero(counts > budget)
    coder.prolong(heavy + 1, counts[heavy], budget)
    known = []
    for depth in range(2, DEPTH):
        found = _longer(rows, coder, depth, budget, buffer) if len(coder.heavy[-1][0]) else []
        keys = np.zeros(len(found), dtype=np.int64)
        for d in range(depth):
            keys = keys << _BITS | np.array([r[f"w{d}"] for r in found], dtype=np.int64)
        coder.prolong(keys, np.array([r["n"] for r in found], dtype=np.int64), budget)
        known += [(coder.words[r["w0"] - 1][0], b" ".join(coder.words[r[f"w{d}"] - 1][1] for d in range(depth)), depth, r["n"]) for r in found if r["n"] >= least]
    found = _subtrees(_leaf_blocks(rows, coder, buffer), coder, least)
    if known:
        found = found.unionByName(docs.sparkSession.createDataFrame(known, "lang string, phrase binary, m int, a long"))
    return words, stage(found)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """The ``top`` collocations of each language of ``docs`` (text, lang; further columns are ignored).

    Texts are cut at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and tabs; A-Z lose their case. A phrase of two to four
    words that occurs a >= ``least`` times is a candidate. Cut in two, its parts occur l and r times; its score is floor(2,000,000 a / (l + r))
    at the cut where that is least (the first of equals). A candidate inside a longer one that occurs at least 0.8 times as often is
    dropped. Returns lang, rank (from 1, by score and a, both descending, then phrase in the order of its bytes), phrase, a, l, r, n (all words of
    the language), score. A null text is empty, a null language is ``und``; repeated rows count each time. An empty table gives an empty result.
    """
    words, phrases = frequent_phrases(docs, least, **options)
    text = lambda c: F.col(c).cast("string").alias("phrase")
    known = phrases.select("lang", text("phrase"), "a").unionByName(words.where(F.col("n") >= least).select("lang", text("word"), F.col("n").alias("a")))
    part = lambda name, count: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("a").alias(count))
    candidates = phrases.select("lang", text("phrase"), "m", "a", F.split(F.col("phrase").cast("string"), " ", -1).alias("w"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("right"))
    cut = cut.join(part("part", "l"), (F.col("lang") == F.col("part_lang")) & (F.col("left") == F.col("part"))).drop("part", "part_lang", "left")
    cut = cut.join(part("part", "r"), (F.col("lang") == F.col("part_lang")) & (F.col("right") == F.col("part")))
    # Whole numbers of 38 digits: no product is cut off.
    cut = cut.withColumn("score", F.expr(f"(cast({2_000_000} as decimal(10)) * cast(a as decimal(19))) div (cast(l as decimal(19)) + cast(r as decimal(19)))"))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = candidates.where("m > 2").select("lang", "w", "a", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("j"))
    inner = inner.select("lang", "w", "a", "j", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("j") + 1)).alias("i"))
    longer = inner.groupBy(F.col("lang").alias("in_lang"), F.array_join(F.slice("w", F.col("i"), F.col("j")), " ").alias("in_phrase")).agg(F.max("a").alias("longer"))
    scored = scored.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    scored = scored.where("longer is null or cast(longer as decimal(20)) * 100 < cast(a as decimal(20)) * 80")
    # First the best of each of several shares of a language, so that no task sees all of its phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = stage(out)
    drop(words)
    drop(phrases)
    return out


COLLOCATIONS_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) s from documents),
w as (select lang, regexp_extract_all(s, '[^\x20\x09]+') w from p),
t as (select lang, sum(len(w))::bigint n from w group by lang),
e as (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from w, range(1, 5) x(m)),
f as materialized (select lang, m, array_to_string(w[i : i + m - 1], ' ') phrase, count(*) a from e group by all having count(*) >= 30),
c as materialized (select *, string_split(phrase, ' ') q from f where m > 1),
y as (select lang, phrase, a, k, array_to_string(q[1 : k], ' ') lp, array_to_string(q[k + 1 :], ' ') rp from c, range(1, 4) x(k) where k < m),
k as (select y.lang, y.phrase, y.a, k, l.a l, r.a r, (2000000::hugeint * y.a // (l.a + r.a))::bigint score
  from y join f l on l.lang = y.lang and l.phrase = lp join f r on r.lang = y.lang and r.phrase = rp),
s as (select lang, phrase, any_value(a) a, min(struct_pack(score := score, k := k, l := l, r := r)) x from k group by lang, phrase),
j as (select lang, q, m, a, j, unnest(range(1, m - j + 2)) i from c, range(2, 4) x(j) where j < m),
g as (select lang, array_to_string(q[i : i + j - 1], ' ') phrase, max(a) longer from j group by all),
o as (select s.lang, s.phrase, s.a, x.l, x.r, x.score, row_number() over (partition by s.lang order by x.score desc, s.a desc, s.phrase) "rank"
  from s left join g using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * s.a)
select lang, "rank", phrase, a, l, r, n, score from o join t using (lang) where "rank" <= 2000
"""
