"""Sentences of a block and the boxes they cover on its lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.functions.arrays import let, running_starts


def sentence_spans(text) -> F.Column:
    """array<struct<text, start, stop>>: trimmed sentences with character offsets."""
    t = F.col(text) if isinstance(text, str) else text
    cut = F.struct(
        F.split(t, V.SENTENCE_BOUNDARY).alias("pieces"),
        F.regexp_extract_all(t, F.lit(V.SENTENCE_BOUNDARY), F.lit(0)).alias("gaps"))

    def placed(c):
        widths = F.transform(c["pieces"], lambda p, k: F.length(p) + F.coalesce(F.length(F.get(c["gaps"], k)), F.lit(0)))

        def spans(starts):
            def span(piece, k):
                body, start = F.regexp_replace(piece, r"(?U)^\s+", ""), F.get(starts, k)
                return F.struct(
                    body.alias("text"), (start + F.length(piece) - F.length(body)).alias("start"),
                    (start + F.length(piece)).alias("stop"))

            return F.filter(F.transform(c["pieces"], span), lambda s: s["text"] != "")

        return let(running_starts(widths), spans)

    return let(cut, placed)


def placed_lines(lines) -> F.Column:
    """Lines with ``at``, the offset of each in the joined text."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    starts = running_starts(F.transform(lines, lambda x: F.length(x["text"]) + 1))
    return let(starts, lambda at: F.transform(lines, lambda x, k: x.withField("at", F.get(at, k))))


def sentence_boxes(lines, start, stop) -> F.Column:
    """Boxes of a character range on placed lines: a line's width is spread evenly over its characters."""

    def clip(line):
        n, at = F.length(line["text"]), line["at"]
        lo, hi = F.greatest(start, at), F.least(stop, at + n)
        step = (line["x1"] - line["x0"]) / n
        return F.struct(
            F.round(line["x0"] + (lo - at) * step, 2).alias("x0"), F.round(line["y0"], 2).alias("y0"),
            F.round(line["x0"] + (hi - at) * step, 2).alias("x1"), F.round(line["y1"], 2).alias("y1"))

    met = F.filter(lines, lambda x: (x["at"] < stop) & (x["at"] + F.length(x["text"]) > start))
    return F.transform(met, clip)


def build_sentences(text="text", lines="lines") -> F.Column:
    """array<struct<text, boxes>>; a sentence that covers no line is dropped."""

    def over(ls):
        placed = F.transform(sentence_spans(text), lambda s: F.struct(
            s["text"].alias("text"), sentence_boxes(ls, s["start"], s["stop"]).alias("boxes")))
        return F.filter(placed, lambda s: F.size(s["boxes"]) > 0)

    return let(placed_lines(lines), over)


def flat_sentences(blocks: DataFrame, *keys: str) -> DataFrame:
    return blocks.select(*keys, F.posexplode("sentences").alias("k", "s")).select(
        *keys, "k", F.col("s.text").alias("text"), F.col("s.boxes").alias("boxes")
    )


def phrase_boxes(sentence, term) -> F.Column:
    """Boxes of a term inside a sentence whose text is spread over its boxes by width."""
    held = F.struct(sentence["text"].alias("text"), sentence["boxes"].alias("boxes"), term.alias("term"))
    # Bound as a lambda variable: the sentence is computed once, however it was made.
    return F.get(F.transform(F.array(held), _phrase_boxes), F.lit(0))


def _phrase_boxes(held) -> F.Column:
    text, boxes, needle = held["text"], held["boxes"], F.regexp_replace(held["term"], r"(?U)^\s+|\s+$", "")
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    size = F.greatest(F.length(text), F.lit(1))

    def width(bs):
        return F.aggregate(bs, F.lit(0.0), lambda acc, b: acc + F.greatest(F.lit(0.0), b["x1"] - b["x0"]))

    total = width(boxes)

    def clip(b, k):
        w = F.greatest(F.lit(0.0), b["x1"] - b["x0"])
        before = width(F.slice(boxes, 1, k))
        lo, hi = before / total * size, (before + w) / total * size
        s, e = F.greatest(at.cast("double"), lo), F.least((at + F.length(needle)).cast("double"), hi)
        return F.when(e > s, F.struct(
            (b["x0"] + (s - lo) / (hi - lo) * w).alias("x0"), b["y0"].alias("y0"),
            (b["x0"] + (e - lo) / (hi - lo) * w).alias("x1"), b["y1"].alias("y1"),
        ))

    usable = (needle != "") & (at >= 0) & (total > 0)
    return F.when(usable, F.filter(F.transform(boxes, clip), lambda b: b.isNotNull())).otherwise(
        F.slice(boxes, 1, 0)
    )
