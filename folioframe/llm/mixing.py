"""Mixing to target weights with soft membership.

A classifier learned from the table of labels says how likely a document belongs to each domain (here: the
four pairs of quality and toxicity). Every document gets a rate of zero or more, the expected number of its
copies in the mixture. Projected-gradient least squares fits the rates: a turn sums the expected tokens of
each domain over all documents, and each document moves against the gradient, which depends on its own
posteriors and on a few global numbers only. So a turn is one pass over a slim table, the rates follow
from the list of those numbers, and nothing but sums reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stage, word_hashes
from folioframe.llm.packing import words

WORD_PLACES, SIGN_LEVELS = 1 << 16, 16
PLACES = WORD_PLACES + 128 * SIGN_LEVELS
# quality, toxic of each domain, and the share of tokens that the mixture should have of it.
DOMAINS = ((1, 0), (0, 0), (1, 1), (0, 1))
WEIGHTS = (0.90, 0.08, 0.015, 0.005)

_SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def places(text: str | None) -> np.ndarray:
    """What a text contains: the places of its hashed words, and of its marks (each with how dense it is, by powers of two)."""
    words_ = (word_hashes(text) % np.uint64(WORD_PLACES)).astype(np.int64)
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)[_SIGNS]
    level = np.minimum(SIGN_LEVELS - 1, np.log2(1 + 1000 * count[count > 0] / max(1, len(raw))).astype(np.int64))
    return np.unique(np.concatenate((words_, WORD_PLACES + _SIGNS[count > 0] * SIGN_LEVELS + level)))


@dataclass(frozen=True)
class Classifier:
    """Multinomial logistic regression on the presence of chosen places.

    The row of each place in ``weights`` (-1: none), weights, bias, and which domains had labelled documents; the others have no posterior.
    """

    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    seen: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for i, t in enumerate(texts):
            at = self.row[places(t)]
            out[i] += self.weights[at[at >= 0]].sum(axis=0)
        out = np.where(self.seen, out, -np.inf)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def _fit(at: list[np.ndarray], domain: np.ndarray, most_places: int, turns: int, decay: float) -> Classifier:
    """Choose the places that tell most about the domain (chi square), then Newton-like steps with a diagonal bound."""
    n, k = len(at), len(DOMAINS)
    held = np.bincount(domain, minlength=k)
    seen = np.zeros((k, PLACES))
    for a, d in zip(at, domain):
        seen[d, a] += 1
    total = seen.sum(axis=0)
    expected = np.outer(held, total) / n
    gap = (seen - expected) ** 2
    chi = np.divide(gap, expected, out=np.zeros_like(gap), where=expected > 0).sum(axis=0) * (total >= 5)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:most_places])
    chosen = chosen[chi[chosen] > 0]
    row = np.full(PLACES, -1, dtype=np.int32)
    row[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, a in enumerate(at):
        r = row[a]
        x[i, r[r >= 0]] = 1
    y = np.eye(k, dtype=np.float32)[domain]
    w = np.zeros((len(chosen) + 1, k), dtype=np.float32)
    # Adaptive steps: each weight moves by the size of its own gradients so far.
    power = np.full_like(w, 1e-8)
    for _ in range(turns):
        p = x @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / n + decay * w
        power += g * g
        w -= 0.5 * g / np.sqrt(power)
    return Classifier(row, w[:-1], w[-1], held > 0)


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = 4000, most_places: int = 512, turns: int = 200, decay: float = 1e-4) -> Classifier:
    """Learn the domains from at most ``most`` labelled documents: of the labels whose ids are among ``docs``, those with the smallest hashes.

    Labels with a null, or with values outside 0 and 1, take no part; an id with several labels counts with each.
    Without labelled documents all domains are equally likely.
    """
    domain = F.coalesce(*[F.when((F.col("quality") == q) & (F.col("toxic") == t), i) for i, (q, t) in enumerate(DOMAINS)])
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
    # Labels of documents that are not here must not use up the sample.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    # Bounded by ``most``, so it may go to every executor.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most))

    def extract(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("domain"), pa.array([places(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))],
                                             names=["h", "domain", "at"])

    near = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), F.col("domain").cast("int").alias("domain"), "text")
    rows = near.mapInArrow(extract, "h long, domain int, at array<long>").orderBy("h", "domain").limit(most).toArrow()
    if not rows.num_rows:
        return Classifier(np.full(PLACES, -1, dtype=np.int32), np.zeros((0, len(DOMAINS))), np.zeros(len(DOMAINS)), np.ones(len(DOMAINS), dtype=bool))
    at = rows.column("at").combine_chunks()
    ends = at.offsets.to_numpy()[1:-1] - at.offsets[0].as_py()
    return _fit(np.split(at.flatten().to_numpy(), ends), rows.column("domain").to_numpy(), most_places, turns, decay)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """Stage table rid, doc_id, text_hash, tokens, p (posteriors) of every row; the whole text counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("tokens"), "text")

    def run(batches):
        for batch in batches:
            p = held.value.posteriors(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "tokens")), pa.array(list(p), pa.list_(pa.float64()))],
                                             names=["doc_id", "text_hash", "tokens", "p"])

    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, tokens long, p array<double>")
    return stage(made.select(F.monotonically_increasing_id().alias("rid"), "*"))


def _rates(moves: list[np.ndarray], most: float | None) -> Column:
    """The rate of a document after these moves, and the one before.

    A move holds how far to go on in the last direction, and the gradient there; the rate goes against it and back into [0, most], or to 0 or more without ``most``.
    """
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("prev"))
    if not moves:
        return start
    k = len(moves[0]) - 1
    turns = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in moves])

    def step(x, m):
        slope = sum((m[j + 1] * F.col("p")[j] for j in range(1, k)), m[1] * F.col("p")[0])
        new = x["r"] + m[0] * (x["r"] - x["prev"]) - slope
        new = new if most is None else F.least(F.lit(float(most)), new)
        return F.struct(F.greatest(F.lit(0.0), new).alias("r"), x["r"].alias("prev"))

    return F.aggregate(turns, start, step)


def fit_rates(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float | None = None, turns: int = 60, close: float = 1e-3) -> tuple[Column, np.ndarray]:
    """The rate of each row (tokens, p), and the expected share of each domain that the rates reach.

    The targets are ``weights`` times all tokens. Rates are zero or more, with no upper bound unless ``most`` sets one.
    Gradients are measured in the metric of the expected
    membership counts (a small matrix summed over all rows), so domains that resemble each other
    converge as fast as others. Turns end when no share is off by more than ``close``, when five turns have not lowered the squared error by a
    thousandth (targets that cannot be reached are met as far as least squares can), or after ``turns``.
    """
    k = len(weights)
    goal = np.array(weights) / sum(weights)
    pair = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]
    total = rows.agg(F.sum("tokens").alias("total"), *pair).first()
    if not total["total"]:
        return F.lit(1.0), np.zeros(k)
    metric = np.array([[total[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / total["total"]
    inverse = np.linalg.inv(metric + 1e-6 * np.eye(k))

    moves: list[np.ndarray] = []
    age, losses = 1.0, [np.inf]
    while True:
        at = rows.select("tokens", "p", _rates(moves, most).alias("x"))
        sums = at.agg(*[F.sum(F.col("tokens") * F.col("x")[f] * F.col("p")[j]).alias(f"{f}{j}") for f in ("r", "prev") for j in range(k)]).first()
        shares, before = (np.array([sums[f"{f}{j}"] for j in range(k)]) / total["total"] for f in ("r", "prev"))
        loss = float((shares - goal) @ inverse @ (shares - goal))
        stalled = len(losses) > 5 and losses[-5] - loss <= 1e-3 * losses[-5]
        if np.abs(shares - goal).max() <= close or stalled or len(moves) == turns:
            return _rates(moves, most)["r"], shares
        # A whole step never overshoots in this metric. Going on in the last direction speeds it up, and stops where the loss has risen.
        age = 1.0 if loss > losses[-1] else age
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        on = (older - 1) / age
        losses.append(loss)
        moves.append(np.concatenate(([on], inverse @ (shares + on * (shares - before) - goal))))


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, **options) -> DataFrame:
    """What ``mix_and_shares`` returns, without the shares."""
    return mix_and_shares(docs, labels, weights, **options)[0]


def mix_and_shares(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, **options) -> tuple[DataFrame, np.ndarray]:
    """Rates and copies of ``docs`` (doc_id, text; further columns are ignored) that bring the domains to ``weights``.

    A domain without labelled documents takes no part; the weights of the others keep their proportions.

    Returns the expected share of each domain that the rates reach, after a table with a row per row: doc_id, text_hash, tokens, p (posterior of each domain, in the order of ``DOMAINS``), rate, copies:
    the whole part of the rate, and one more with the chance of the rest, drawn by a hash of the row's id and text.
    A null text counts as empty; a text without tokens weighs nothing, and gets a rate like any other. Repeated rows get the same rate
    and the same draw. An empty table gives an empty result.
    """
    model = fit_classifier(docs, labels)
    rows = posteriors(docs, model)
    rate, shares = fit_rates(rows, tuple(w if s else 0.0 for w, s in zip(weights, model.seen)), **options)
    draw = F.xxhash64("doc_id", "text_hash").cast("double") / 2.0**64 + 0.5
    out = stage(rows.select("doc_id", "text_hash", "tokens", "p", rate.alias("rate")))
    out = out.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    return out, shares
