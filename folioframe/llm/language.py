"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of its letter n-grams, hashed to a fixed number of places.
Each language has several centroids, clustered from a bounded sample of labelled rows; a text takes the
language of the centroid with the greatest cosine. A text that is further from all centroids than
labelled texts of its length ever are is rejected.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import arrow_rows, code_points, drop, stage

PLACES = 4096
_CHARS = 1 << 20
_LENGTHS = 24
UNKNOWN = "und"
# No cosine below this is a known language, however short the text; characters that a stretch of a long text has in common with the one before.
_LEAST, _OVERLAP = 0.02, 64

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _LETTER


def _grams(texts: list[str]) -> np.ndarray:
    """Counts of the 1- to 3-grams of each text (lower case, everything but letters as one gap), one row of ``PLACES`` counts each."""
    joined = code_points("\0\0".join(t.lower() for t in texts) + "\0\0")
    # Lower case changes the length of few texts; the separators tell where each begins.
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    points = _letters()[joined]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    points, row = points[keep], row[keep]
    counts = np.zeros(len(texts) * PLACES, dtype=np.int64)
    hashed = points
    for n in (1, 2, 3):
        if n > 1:
            if len(hashed) < 2:
                break
            hashed = hashed[:-1] * np.uint32(0x9E3779B1) + points[n - 1 :]
        base, inside = row[: len(hashed)], row[: len(hashed)] == row[n - 1 :]
        inside &= points[: len(hashed)] != 0 if n == 1 else True
        places = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        counts += np.bincount(base[inside] * PLACES + places[inside], minlength=len(counts))
    return counts.reshape(len(texts), PLACES)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of n-grams of whole texts. A very long text is counted in stretches that share the characters an n-gram can span."""
    out, group, size = [], [], 0

    def flush():
        nonlocal group, size
        if group:
            out.append(_grams(group))
            group, size = [], 0

    for t in texts:
        if len(t) > _CHARS:
            flush()
            # A stretch begins some characters early; what these hold by themselves has been counted before.
            whole = _grams([t[:_CHARS]])
            for i in range(_CHARS, len(t), _CHARS):
                both = _grams([t[i - _OVERLAP : i + _CHARS], t[i - _OVERLAP : i]])
                whole += both[:1] - both[1:]
            out.append(whole)
            continue
        if size + len(t) > _CHARS or len(group) == 128:
            flush()
        group.append(t)
        size += len(t)
    flush()
    return np.concatenate(out) if out else np.empty((0, PLACES), dtype=np.int64)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


@dataclass(frozen=True)
class Model:
    """Centroids (unit rows), the language of each, inverse document frequencies, and the least cosine by length class."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> dict:
        counts = gram_counts([t or "" for t in texts])
        total = counts.sum(axis=1)
        cosines = weighted(counts, self.idf) @ self.centroids.T if len(self.languages) else np.zeros((len(texts), 0))
        best = cosines.argmax(axis=1) if len(self.languages) else np.zeros(len(texts), dtype=int)
        none = (total == 0) | (not self.languages)
        score = np.array([0.0 if n else min(1.0, max(0.0, float(c[b]))) for n, c, b in zip(none, cosines, best)])
        rejected = none | (score < self.least[length_class(total)])
        return {"lang_pred": [UNKNOWN if n else self.languages[b] for n, b in zip(none, best)], "score": score, "rejected": rejected}


def length_class(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(int), _LENGTHS - 1)


def sample(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """At most ``per_language`` rows (text, lang) of each language, those with the smallest hashes."""
    every = labelled.groupBy("lang").count()
    counts = every.orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if len(counts) == most_languages and (left := every.count() - most_languages):
        warnings.warn(f"{left} languages beyond most_languages={most_languages} are not learned", stacklevel=2)
    if not counts:
        return labelled.limit(0).select("text", "lang")
    # A threshold on the hash leaves about three times the wanted rows of each language, so few texts move.
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 3 * per_language / r["count"]))) for r in counts], F.lit(0.0))
    hashed = labelled.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    few = hashed.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang")


def _cluster(vectors: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors: the first is the mean, the others start at the vector least like those before."""
    unit = lambda v: v / max(float(np.sqrt(v @ v)), 1e-12)
    centers = [unit(vectors.mean(axis=0))]
    while len(centers) < min(k, len(vectors)):
        centers.append(vectors[(vectors @ np.array(centers).T).max(axis=1).argmin()])
    centers = np.array(centers)
    for _ in range(turns):
        own = (vectors @ centers.T).argmax(axis=1)
        centers = np.array([unit(vectors[own == j].mean(axis=0)) if (own == j).any() else c for j, c in enumerate(centers)])
    return centers.astype(np.float32)


def _stretch(text: str, c: int) -> str | None:
    """A stretch of a text with about as many n-grams as length class ``c`` has; none if the text is shorter."""
    size = max(1, (3 << c) // 6)
    if len(text) < size:
        return None
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(text) - size + 1)
    return text[at : at + size]


def _bounds(texts: DataFrame, model: Model, margin: float, share: float) -> np.ndarray:
    """The least cosine by length class: ``margin`` times that which all but a ``share`` of the stretches of known texts of that length exceed.

    It does not fall as texts get longer, and is never below ``_LEAST``. All classes have stretches, whatever the lengths of the texts.
    """
    def measure(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                cut = [x for x in (_stretch(t, c) for c in range(_LENGTHS)) if x]
                counts = gram_counts([t, *cut])
                total = counts.sum(axis=1)
                cosine = (weighted(counts, model.idf) @ model.centroids.T).max(axis=1).astype(np.float64)
                good = total > 0
                yield pa.RecordBatch.from_arrays([pa.array(length_class(total)[good], pa.int32()), pa.array(cosine[good])], names=["class", "cosine"])

    at = F.percentile("cosine", F.lit(share))
    found = {r["class"]: r["least"] for r in texts.select("text").mapInArrow(measure, "class int, cosine double").groupBy("class").agg(at.alias("least")).collect()}  # a row per class
    bound, last = np.zeros(_LENGTHS), _LEAST
    for c in range(_LENGTHS):
        last = max(last, margin * found.get(c, 0.0))
        bound[c] = last
    return bound


def fit(labelled: DataFrame, per_language: int = 1000, centroids: int = 4, most_languages: int = 200, margin: float = 0.5, share: float = 0.01) -> Model:
    """Learn from labelled rows (doc_id, text, lang; none null): a sample of at most ``per_language`` rows for each of at most ``most_languages`` (the most
    frequent; a warning names how many are left out). Texts are rejected below a bound that grows with their length (``_bounds``).
    """
    def features(batch: pa.RecordBatch) -> dict:
        counts = gram_counts(batch.column("text").to_pylist())
        return {"lang": batch.column("lang"), "counts": [c.astype("<u4").tobytes() for c in counts]}

    fields = pa.schema([("lang", pa.string()), ("counts", pa.binary())])
    texts = stage(sample(labelled, per_language, most_languages).repartition(16))
    rows = stage(texts.mapInArrow(arrow_rows(features, fields), "lang string, counts binary"))

    def frequencies(batches):
        total, n = np.zeros(PLACES, dtype=np.int64), 0
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, dtype="<u4") > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "total"])

    # One row per partition of the bounded sample.
    parts = rows.mapInArrow(frequencies, "n long, total binary").collect()
    n = sum(r["n"] for r in parts)
    seen = sum((np.frombuffer(r["total"], dtype=np.int64) for r in parts), np.zeros(PLACES, dtype=np.int64))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.array([np.frombuffer(c, dtype="<u4") for c in frame["counts"]])
        filled = counts.sum(axis=1) > 0
        if not filled.any():
            return pd.DataFrame({"lang": [], "center": []})
        centers = _cluster(weighted(counts[filled], idf), centroids)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "center": [c.tobytes() for c in centers]})

    found = rows.groupBy("lang").applyInPandas(learn, "lang string, center binary").orderBy("lang", "center").collect()
    centers = np.array([np.frombuffer(r["center"], dtype=np.float32) for r in found]).reshape(len(found), PLACES)
    model = Model([r["lang"] for r in found], centers, idf, np.full(_LENGTHS, _LEAST))
    if found:
        model = replace(model, least=_bounds(texts, model, margin, share))
    drop(texts)
    drop(rows)
    return model


_PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Add lang_pred, score (the cosine, 0 to 1) and rejected to the columns ``keep`` of ``docs``; the whole text counts.

    A null text, or one without a letter, is ``und`` with score 0, and rejected; so is every text if nothing was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *_PREDICTED])

    def run(batches):
        for batch in batches:
            found = held.value.predict(batch.column(len(keep)).to_pylist())
            columns = [*batch.columns[: len(keep)], pa.array(found["lang_pred"], pa.string()), pa.array(found["score"], pa.float64()), pa.array(found["rejected"], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, which are never learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn_languages(docs: DataFrame, **options) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are labelled and not held out."""
    return fit(docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))), **options)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang; further columns are ignored): doc_id, held_out, lang_pred, score, rejected.

    Repeated rows get equal results. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, learn_languages(docs), ["doc_id", "held_out"])
