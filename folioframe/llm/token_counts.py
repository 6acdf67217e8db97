"""Token counts that follow edits.

The tree of a document has leaves of some hundred characters, cut where no token can span the cut, each
with its length in characters and its tokens; inner nodes hold the sums of their subtrees. An edit
encodes again only the leaves it touches, and a neighbour where the edit touches the context of a cut;
the sums above them are updated. The count of the whole document is the root.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 512
# A cut stands before a single space between two letters: letters, then a space that goes with the letters behind it.
# Latin letters are told by this pattern; a text without such places is one leaf, or few.
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")

_encodings: dict = {}


def counter(path: str, pattern: str):
    """A function from texts to numbers of tokens, for a byte-level vocabulary of ranks and its pre-token pattern."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encodings[path] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    return _encodings[path]


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """The text in leaves of about ``leaf`` characters; together they are the text."""
    out, begin = [], 0
    while len(text) - begin > leaf:
        at = _CUT.search(text, begin + leaf)
        if not at:
            break
        out.append(text[begin : at.start()])
        begin = at.start()
    return [*out, text[begin:]]


class Tree:
    """Sums of lengths and tokens over leaves; node 1 is the root, nodes ``width`` on are the leaves."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.n = len(lengths)
        self.width = 1 << max(0, int(self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width : self.width + self.n, 0], self.sums[self.width : self.width + self.n, 1] = lengths, tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, text: str, count, leaf: int = LEAF) -> Tree:
        parts = cut(text, leaf)
        return cls(np.array([len(p) for p in parts]), np.array(count(parts)))

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.sums[self.width : self.width + self.n]
        return held[:, 0], held[:, 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one for the end of the text), and where the leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, self.n - 1), begin

    def put(self, leaf: int, length: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([length, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, place: int, removed: int, added: str, count, leaf: int = LEAF) -> tuple[Tree, str, int]:
        """Replace ``removed`` characters at ``place`` by ``added``: the tree, the text, and how many characters were encoded again.

        Places beyond the end are taken as the end.
        """
        place = min(max(0, place), len(text))
        end = min(len(text), place + max(0, removed))
        first, begin = self.find(place)
        last, last_begin = self.find(max(place, end - 1))
        stop = last_begin + int(self.sums[self.width + last, 0])
        # The cut before the first leaf needs the two characters behind it, the cut behind the last leaf the one before it and the two behind it.
        while first > 0 and place < begin + 2:
            first -= 1
            begin -= int(self.sums[self.width + first, 0])
        while last < self.n - 1 and end >= stop:
            last += 1
            stop += int(self.sums[self.width + last, 0])
        region = text[begin:place] + added + text[end:stop]
        new = text[:place] + added + text[end:]
        slots = last - first + 1
        parts = cut(region, leaf)
        tokens = count(parts)
        if len(parts) > 2 * slots + 2:
            # Far more leaves than before: the tree is laid out anew from the counts it has; nothing else is encoded.
            lengths, held = self.leaves()
            sizes = np.array([len(p) for p in parts])
            tree = Tree(np.concatenate((lengths[:first], sizes, lengths[last + 1 :])), np.concatenate((held[:first], tokens, held[last + 1 :])))
            return tree, new, len(region)
        # The new leaves share the slots of the old ones; a slot may stay empty or hold several.
        for k, group in enumerate(np.array_split(np.arange(len(parts)), slots)):
            self.put(first + k, sum(len(parts[i]) for i in group), sum(tokens[i] for i in group))
        return self, new, len(region)


def with_trees(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``docs`` with the leaves of each document's tree in the new column ``leaves`` (arrays ``lengths`` and ``tokens``); a null text counts as empty."""
    kept = [f for f in docs.schema if f.name != "leaves"]
    rows = docs.select(*[f"`{f.name}`" for f in kept])
    kind = pa.struct([("lengths", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            trees = [cut(t.as_py() or "", leaf) for t in batch.column("text")]
            made = pa.array([{"lengths": [len(p) for p in parts], "tokens": count(parts)} for parts in trees], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "leaves"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, leaves struct<lengths:array<int>,tokens:array<int>>")


def attach_edits(treed: DataFrame, edits: DataFrame) -> DataFrame:
    """Put the edits (doc_id, seq, place, removed, added) of each document, in the order of ``seq``, into the column ``edits``."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place", "removed", "added"))).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["place"].alias("place"), e["removed"].alias("removed"), e["added"].alias("added"))).alias("edits"))
    return treed.drop("edits").join(lists, "doc_id", "left")


def apply_edits(treed: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Apply ``edits`` (array of place, removed, added; in order, each on the text the one before left) to rows with ``text`` and ``leaves``.

    Returns doc_id, before and after (tokens), encoded (characters encoded again), text and leaves after the edits.
    Null or empty edits leave a document as it is; nulls inside an edit count as 0 and as an empty text. A null text counts as empty.
    Repeated rows are edited each. An empty table gives an empty result.
    """
    rows = treed.select("doc_id", "text", "leaves", "edits")
    kind = pa.struct([("lengths", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            before, after, encoded, texts, leaves = [], [], [], [], []
            for text, held, edits in zip(*(batch.column(c) for c in ("text", "leaves", "edits"))):
                text = text.as_py() or ""
                tree = Tree(np.array(held["lengths"].as_py()), np.array(held["tokens"].as_py()))
                before.append(tree.tokens)
                again = 0
                for e in edits.as_py() or []:
                    tree, text, n = tree.edit(text, e["place"] or 0, e["removed"] or 0, e["added"] or "", count, leaf)
                    again += n
                lengths, tokens = tree.leaves()
                after.append(tree.tokens)
                encoded.append(again)
                texts.append(text)
                leaves.append({"lengths": lengths.tolist(), "tokens": tokens.tolist()})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(encoded, pa.int64()), pa.array(texts, pa.string()), pa.array(leaves, kind)],
                                             names=["doc_id", "before", "after", "encoded", "text", "leaves"])

    doc_id = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc_id}, before long, after long, encoded long, text string, leaves struct<lengths:array<int>,tokens:array<int>>")
