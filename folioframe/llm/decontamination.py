"""Benchmark decontamination: which words of a document lie inside a passage of a benchmark.

One Aho-Corasick automaton holds the windows of all test questions and answers, as sequences of words in normal
form; a letter of the automaton is a word. A document is brought into normal form and goes through the
automaton once. The normal form keeps the place of every byte, so words map back to the original text.

A window is ten words in a row; an item with fewer words is one window. Items are a small table as a rule: their
windows travel to the tasks, ``MOST_BYTES`` of their texts at a time. A larger table is cut into blocks, and the documents
go through one automaton per block.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import drop, stage

WINDOW = 10
MOST_BYTES = 1 << 20
# A document goes through the automaton in stretches of about so many bytes; its state goes on from one to the next.
STRETCH = 1 << 20

# Bytes outside 0-9, a-z and 80-FF become spaces, A-Z lose their case; nothing changes its place.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_UNKNOWN = "\0"


def folded(raw: bytes) -> bytes:
    """The normal form: words apart by spaces, each word where it was."""
    return raw.translate(_FOLD)


def _letter(i: int) -> str:
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


class Scanner:
    """The automaton of the windows of ``items``: (id, texts in UTF-8), each id once."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.letters: dict[bytes, str] = {}
        self.ids = [i for i, _ in items]
        owners: dict[str, set[int]] = {}
        for n, (_, texts) in enumerate(items):
            for text in texts:
                words = folded(text).split()
                line = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in words)
                for at in range(max(0, len(line) - window) + 1 if line else 0):
                    owners.setdefault(line[at : at + window], set()).add(n)
        self.automaton = ahocorasick.Automaton()
        for part, held in owners.items():
            self.automaton.add_word(part, (len(part), sorted(held)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """How many words a text has, the runs of words [begin, end) that lie inside windows, and the items whose windows occur."""
        line = folded(raw)
        count, runs, items = 0, [], set()
        search, begin = None, 0
        while begin < len(line):
            end = line.find(b" ", begin + STRETCH) if len(line) - begin > STRETCH else -1
            end = len(line) if end < 0 else end
            words = line[begin:end].split()
            begin = end
            count += len(words)
            if self.empty:
                continue
            letters = "".join(map(self.letters.get, words, repeat(_UNKNOWN)))
            if search is None:
                search = self.automaton.iter(letters)
            else:
                search.set(letters, False)
            for last, (length, held) in search:
                items.update(held)
                first = last + 1 - length
                while runs and runs[-1][1] >= first:  # ends ascend, so runs that touch are at the end of the list
                    first = min(first, runs.pop()[0])
                runs.append((first, last + 1))
        return count, runs, items


def spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of runs of words in the original text, in characters."""
    if not runs:
        return []
    blank = np.frombuffer(folded(raw), dtype=np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    flat = np.array(runs)
    places = np.stack((edges[::2][flat[:, 0]], edges[1::2][flat[:, 1] - 1]), axis=1).ravel()
    heads = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80  # one per character
    pieces = [int(np.count_nonzero(heads[a:b])) for a, b in zip(np.concatenate(([0], places[:-1])), places)]
    chars = np.cumsum(pieces)
    return list(zip(chars[::2].tolist(), chars[1::2].tolist()))


def _blocks(items: DataFrame, columns: tuple[str, ...], most: int):
    """The items in blocks of about ``most`` bytes, each as a list of (id, texts); rows with one id are one item."""
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.explode(F.array(*[F.col(c).cast("binary") for c in columns])).alias("t"))
    texts = texts.where("t is not null")
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // most) or 1
    for b in range(blocks):
        # A share of about ``most`` bytes of a table of any size.
        rows = texts.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.collect_list("t").alias("t")).orderBy("id").collect()
        yield b == blocks - 1, [(r["id"], [bytes(t) for t in r["t"]]) for r in rows]


_RUN = "array<struct<begin:long,end:long,start:long,stop:long>>"


def _scanned(rows: DataFrame, items: list, window: int, hits_only: bool) -> DataFrame:
    """``rows`` (head columns, raw) with n_words, runs and item_ids; the text itself goes no further."""
    head = [f for f in rows.schema if f.name != "raw"]

    def run(batches):
        scanner = Scanner(items, window)
        for batch in batches:
            words, runs, ids, keep = [], [], [], []
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                n, found, held = scanner.scan(raw or b"")
                if held or not hits_only:
                    keep.append(i)
                    words.append(n)
                    runs.append([{"begin": a, "end": b, "start": s, "stop": t} for (a, b), (s, t) in zip(found, spans(raw or b"", found))])
                    ids.append(sorted(scanner.ids[x] for x in held))
            if keep:
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "end", "start", "stop")]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(keep)) for f in head), pa.array(words, pa.int64()), pa.array(runs, kind),
                                                  pa.array(ids, pa.list_(pa.string()))], names=[*(f.name for f in head), "n_words", "runs", "item_ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)
    return rows.mapInArrow(run, f"{kinds}, n_words long, runs {_RUN}, item_ids array<string>")


def _together(found: list[DataFrame], every: DataFrame) -> DataFrame:
    """The results of several blocks, one row per document of ``every`` (rid, doc_id, n_words)."""
    union = found[0]
    for df in found[1:]:
        union = union.unionByName(df)
    each = union.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, r: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
        last(a)["begin"].alias("begin"), F.greatest(last(a)["end"], r["end"]).alias("end"), last(a)["start"].alias("start"), F.greatest(last(a)["stop"], r["stop"]).alias("stop"))))
    merged = F.aggregate("runs", F.array().cast(_RUN), lambda a, r: F.when((F.size(a) > 0) & (last(a)["end"] >= r["begin"]), joined(a, r)).otherwise(F.concat(a, F.array(r))))
    return every.join(each.withColumn("runs", merged), "rid", "left").select(
        "doc_id", "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("runs", _RUN), ("item_ids", "array<string>"))])


def find_passages(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("text",), window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """Words of ``docs`` (doc_id, text; further columns are ignored) inside passages of ``items`` (item_id and the texts in ``columns``).

    Returns a row per document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, item_ids (the items with
    occurring windows, as sorted strings), spans (start and end in characters of each run of hit words), contaminated (n_hit > 0).
    Windows lie inside one text of an item. A null text has no words; an item without words has no windows. Rows with equal item_id are
    one item, and so are those with a null item_id, whose id is the empty string. Repeated rows and null or repeated doc_ids
    are rows of their own. An empty table of documents gives an empty result; without items nothing is hit.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    found, source = [], None
    for last, block in _blocks(items, columns, most):
        if last and not found:
            out = _scanned(rows, block, window, hits_only=False).drop("rid")
            break
        source = source or stage(rows.select(F.monotonically_increasing_id().alias("rid"), "*"))
        found.append(stage(_scanned(source.select("rid", "raw"), block, window, hits_only=True)))
        if last:
            every = _scanned(source, [], window, hits_only=False).select("rid", "doc_id", "n_words")
            out = stage(_together(found, every))
            for df in (source, *found):
                drop(df)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["begin"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                      F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("end"))).alias("spans"), (F.size("runs") > 0).alias("contaminated"))


PASSAGES_SQL = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select coalesce(item_id::varchar, '') id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0),
g as (select distinct id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g from bi),
di as (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from g)),
m as (select rid, i, n, id from (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') g from di) join g using (n, g)),
h as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from m) group by rid),
t as (select rid, count(distinct id) n_items, sha256(string_agg(distinct id, ',' order by id)) s from m group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (rid) left join t using (rid)
"""
