"""Token ids in binary files: independent zstandard frames, a document index and a trailing seek table.

File layout. The first part is a sequence of zstandard frames. Each document has frames of its own, so
a reader decompresses nothing but the documents asked for; a document of more than ``FRAME_IDS`` ids
continues in further frames. A skippable frame (magic 0x184D2A50) holds the document index: for each
document doc_id (int64), 1 if the id is null (uint8), and the number of its frames (uint32), then the
number of documents (uint32) and the bytes of one id (uint32). The file ends with the seek table of
the public seekable zstandard format: a skippable frame (0x184D2A5E) with compressed size,
uncompressed size and checksum (low half of XXH64 of the content) of every frame, and a footer.
Any zstandard decompressor restores the ids of a whole file, which are little-endian.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import shared_folder

FRAME_IDS = 1 << 20
INDEX, TABLE, END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frames", "<u4")])
_TABLE_ROW = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

# The white space that the tokenizer's pattern does not count as such, though Python does.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# White space that a visible character follows belongs to that character's unit; the rest of a run is a unit of its own.
_UNIT = re.compile(r"\s?\S+|\s+(?=\s\S|\Z)")


class _Odd(Exception):
    """A text with runs of white space, or with white space at an end."""


class _Units(dict):
    """Ids of units, by the unit without its leading space; a unit that is not held is made on the way."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, part: str) -> bytes:
        e = self.encoder
        word = part.rstrip(".,;:!?")
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        if part.isalpha():
            ids = e.word(self.lead + part)
        elif word != part and word.isalpha():
            # Not held: the word is, and so is what follows it.
            return self[word] + e.plain[part[len(word):]]
        elif "\n" in part:
            # Not held: two words around a line end seldom meet again.
            first, *rest = part.split("\n")
            return self[first] + b"".join([e.line_end + e.plain[p] for p in rest])
        elif any(map(str.isspace, part)):
            raise _Odd
        else:
            ids = e.whole(self.lead + part)
        if len(part) <= e.longest:
            self[part] = ids
        return ids


class Encoder:
    """Ids of whole texts of a byte-level tokenizer.

    A text falls into units before each white space that a visible character follows; the tokenizer never
    joins tokens over such a place. Units repeat, so their ids are kept, up to ``most`` units of ``longest`` characters.
    """

    def __init__(self, path: str, width: int, most: int = 500_000, longest: int = 32):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        # The tokenizer as given finds added tokens in a text; units are cut from texts without any, for which the flag changes nothing.
        self.given, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content for t in self.given.get_added_tokens_decoder().values()]
        self.model, self.kind, self.most, self.longest = self.tokenizer.model, f"<u{width}", most, longest
        # The printable stand-in of each byte, as the library's own pre-tokenizer gives it.
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        split = lambda c: shown.pre_tokenize_str(c)[0][0]
        self.shown = {b: split(chr(b)) for b in range(128)} | {b: split(chr((b & 31) << 6 if b >= 0xC2 else 0x80 | b & 63))[-1 if b < 0xC0 else 0] for b in range(0x80, 0xE0) if b not in (0xC0, 0xC1)}
        self.shown |= {b: split(chr(max(0x800, (b & 15) << 12)))[0] for b in range(0xE0, 0xF0)} | {b: split(chr(max(0x10000, (b & 7) << 18)))[0] for b in range(0xF0, 0xF5)}
        self.packed = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.line_end = self.whole("\n")
        self.plain, self.spaced = _Units(self, ""), _Units(self, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of one word, with or without a space before it: straight from the model."""
        shown = text.replace(" ", self.shown[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def _unit(self, unit: str) -> bytes:
        if unit.isspace():
            return self.whole(unit)
        if unit[0] == " ":
            return self.spaced[unit[1:]]
        return self.whole(unit[0]) + self.plain[unit[1:]] if unit[0].isspace() else self.plain[unit]

    def document(self, text: str) -> bytes:
        """Ids of a text as the tokenizer gives them; a text with the literal of an added token is encoded whole."""
        if text and any(literal in text for literal in self.added):
            return np.array(self.given.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return self(text)

    def __call__(self, text: str) -> bytes:
        """Ids of a text in which the literals of added tokens are plain characters."""
        if not text:
            return b""
        if len(self.plain) + len(self.spaced) > self.most:
            self.plain.clear()
            self.spaced.clear()
        parts = text.split(" ")
        try:
            return self.plain[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))
        except _Odd:
            if _ODD_SPACE.search(text):
                return self.whole(text)
            return b"".join(map(self._unit, _UNIT.findall(text)))

    def _spaced(self, units: list[str]) -> list[bytes | None]:
        """Ids of different units after a space; none for odd ones. Letters with an end of a sentence go straight to the model."""
        held, plain, tokenize, packed = self.spaced, self.plain, self.model.tokenize, self.packed
        space, shown, longest = self.shown[32], self.shown, self.longest
        out = list(map(held.get, units))
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            part = units[i]
            word = part.rstrip(".,;:!?")
            if word.isalpha():
                ids = held.get(word)
                if ids is None:
                    ids = b"".join([packed[t.id] for t in tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(shown)))])
                    if len(word) <= longest:
                        held[word] = ids
                out[i] = ids if word == part else ids + plain[part[len(word):]]
                continue
            try:
                out[i] = held[part]
            except _Odd:
                pass
        return out

    def documents(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts as ``document`` gives them; a unit is looked up once for all of them, and Arrow puts the ids together."""
        if len(self.plain) + len(self.spaced) > self.most:
            self.plain.clear()
            self.spaced.clear()
        cut = [t.partition(" ") for t in texts]
        parts = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.string()), " ")
        rows, units = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        ids = self._spaced(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array([i or b"" for i in ids], pa.large_binary()).take(units.indices)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(joined).to_numpy())))[rows]
        whole = memoryview(joined.buffers()[2] or b"")
        odd = np.concatenate(([0], np.cumsum(np.array([i is None for i in ids], dtype=bool)[units.indices.to_numpy()])))[rows]
        for i, (text, (first, _, _)) in enumerate(zip(texts, cut)):
            if not text or odd[i] != odd[i + 1] or not first or any(literal in text for literal in self.added):
                yield self.document(text)
                continue
            try:
                yield self.plain[first] + whole[ends[i] : ends[i + 1]]
            except _Odd:
                yield self.document(text)


_encoders: dict = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def write_file(fs: pafs.FileSystem, path: str, docs: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write documents (doc_id, ids as bytes) in their order; returns documents and ids written."""
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    index, table, total = [], [], 0
    step = FRAME_IDS * width
    with fs.open_output_stream(path, compression=None) as out:
        for doc_id, ids in docs:
            frames = range(0, max(1, len(ids)), step)
            for at in frames:
                raw = ids[at : at + step]
                packed = packer.compress(raw)
                out.write(packed)
                table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            index.append((doc_id or 0, doc_id is None, len(frames)))
            total += len(ids) // width
        rows = np.array(index, dtype=_INDEX_ROW).tobytes() + struct.pack("<II", len(index), width)
        out.write(struct.pack("<II", INDEX, len(rows)) + rows)
        rows = np.array(table, dtype=_TABLE_ROW).tobytes() + struct.pack("<IBI", len(table), 0x80, END)
        out.write(struct.pack("<II", TABLE, len(rows)) + rows)
    return len(index), total


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != END:
            raise ValueError(f"{path}: no seek table")
        table_at = size - 9 - n * _TABLE_ROW.itemsize - 8
        self.table = np.frombuffer(self._read(table_at + 8, n * _TABLE_ROW.itemsize), dtype=_TABLE_ROW)
        docs, self.width = struct.unpack("<II", self._read(table_at - 8, 8))
        self.index = np.frombuffer(self._read(table_at - 8 - docs * _INDEX_ROW.itemsize, docs * _INDEX_ROW.itemsize), dtype=_INDEX_ROW)
        self.at = np.concatenate(([0], np.cumsum(self.table["packed"].astype(np.int64))))
        self.first = np.concatenate(([0], np.cumsum(self.index["frames"].astype(np.int64))))
        self.unpacker, self.path = zstandard.ZstdDecompressor(), path

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return None if self.index["null"][i] else int(self.index["doc_id"][i])

    def frames(self, i: int) -> Iterator[np.ndarray]:
        """Ids of document ``i`` of the file, frame by frame; a wrong checksum is an error."""
        for k in range(self.first[i], self.first[i + 1]):
            raw = self.unpacker.decompress(self._read(int(self.at[k]), int(self.table["packed"][k])), max_output_size=int(self.table["size"][k]))
            if len(raw) != self.table["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table["check"][k]:
                raise ValueError(f"{self.path}: frame {k} is damaged")
            yield np.frombuffer(raw, dtype=f"<u{self.width}")


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


_WRITTEN = pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
_READ = pa.schema([("file", pa.int32()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_bytes: int = 64 << 20, width: int = 2) -> DataFrame:
    """Encode the whole texts of ``docs`` (doc_id, text; further columns are ignored) into files below ``folder``.

    Documents lie in ascending doc_id order (null first; rows with one doc_id by a hash of their text), over
    all files together. Returns the list of files, in order: file, path, docs, ids. A null text counts as empty; every document
    ends with ``end_id``. ``tokenizer`` is the path of a tokenizers file on every executor, ``width`` the bytes of an id.
    A task that runs twice writes the same file under another name, and only the name that the finished task returns is listed.
    An empty table gives no files.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = open_folder(folder)
        encode, end = encoder(tokenizer, width).documents, end_id.to_bytes(width, "little")
        stream = ((d, ids + end) for b in batches if b.num_rows for d, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())))
        first = next(stream, None)
        if first is None:
            return
        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        n, ids = write_file(fs, path, _chain(first, stream), width)
        yield pa.RecordBatch.from_pylist([{"file": task.partitionId(), "path": f"{folder}/{path.rpartition('/')[2]}", "docs": n, "ids": ids}], schema=_WRITTEN)

    # Written once, before anything reads the list: the list is the only place that names the files.
    done = ordered.mapInArrow(write, "file int, path string, docs long, ids long")
    done.write.parquet(f"{folder}/files")
    return spark.read.schema(done.schema).parquet(f"{folder}/files")


def _chain(first, rest):
    yield first
    yield from rest


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the listed files: file, doc (its place in the file), doc_id, before (ids earlier in the file), n_tokens, ids_crc32.

    Frames are read one at a time and their checksums verified; ``ids_crc32`` is over the ids as little-endian 32-bit integers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = open_folder(path)
                held, before, out = TokenFile(fs, place), 0, []
                for i in range(len(held)):
                    crc = n = 0
                    for ids in held.frames(i):
                        crc, n = zlib.crc32(ids.astype("<u4"), crc), n + len(ids)
                    out.append((file, i, held.doc_id(i), before, n, crc))
                    before += n
                    if len(out) == 4096 or i == len(held) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _READ)], schema=_READ)
                        out = []

    # A task for each file: by key alone, adaptive execution would join this short list into one task, which then reads every file.
    spread = files.select("file", "path").repartitionByRange(max(1, files.count()), "file")
    return spread.mapInArrow(read, "file int, doc long, doc_id long, before long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the documents named in ``wanted`` (doc_id): doc_id, ids. Only their frames are decompressed."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = TokenFile(*open_folder(path))
                keys = pa.array([held.doc_id(i) for i in range(len(held))], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([path] * len(held)), pa.array(range(len(held)), pa.int64())], names=["doc_id", "path", "doc"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for key, path, doc in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = held if held and held.path == open_folder(path)[1] else TokenFile(*open_folder(path))
                ids = np.concatenate(list(held.frames(doc)))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    places = files.select("path").repartition(F.col("path")).mapInArrow(index, "doc_id long, path string, doc long")
    asked = wanted.select(F.col("doc_id").alias("_id")).distinct()
    found = places.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return found.repartition(F.col("path"), F.floor(F.col("doc") / 4096)).sortWithinPartitions("path", "doc").mapInArrow(fetch, "doc_id long, ids array<long>")


def token_digest(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files, read them back, and return per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = write_token_files(docs, folder or shared_folder(docs.sparkSession) + "-tokens", tokenizer, **options)
    # One row per file: a window over all of them gives each file its offset.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    # The list is the small side; Spark would take the documents for it, of which it knows no more than the number of files.
    return read_token_files(files).join(F.broadcast(offsets), "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
