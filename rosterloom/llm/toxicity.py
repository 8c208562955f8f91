"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a text's lower-cased characters, white space as one space, present or
not, hashed into 2^20 places. Each place is scaled by the log of how much more often it is present
in toxic than in other training texts; a logistic regression on the scaled features, regularised,
gives the score. It is fitted on a bounded sample of the labelled rows (`per_class` of either
class, those whose hashed id comes first) in one task; the weights (4 MB) go to every worker, which
scores whole texts.

Defined results: a null or empty text has no features and gets the score that the intercept gives. Rows with a null id are held out by no one and
never learnt from. Ids that are labelled twice are learnt from by their larger label, ids with
several texts by the first text; null labels count as none. Very long texts are read in windows of 2^18 characters, and score
as if read at once (but for a capital sigma at a border in a stretch of 4096 characters without white space). Without toxic training rows all scores are 0. Each row is scored alone; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rosterloom.llm.tables import small_batches

PLACES = 1 << 20
SIZES = (3, 4, 5)
WINDOW = 1 << 18
_SPACE = np.array([32], np.uint32)
_WHITE = re.compile(r"[\x09-\x0D\x20]")


@dataclass(frozen=True)
class Fit:
    """Settings of the training. At most 2 * per_class texts are learnt from."""
    per_class: int = 2500
    smooth: float = 1.0
    rounds: int = 8
    step: float = 0.05
    penalty: float = 1e-4
    seed: int = 4


def _pieces(text: str) -> Iterator[str]:
    """The text in stretches of about WINDOW characters, cut before white space where there is some."""
    at = 0
    while len(text) - at > WINDOW:
        found = _WHITE.search(text, at + WINDOW, at + WINDOW + 4096)
        cut = found.start() if found else at + WINDOW
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _characters(text: str) -> Iterator[np.ndarray]:
    """Lower-cased characters, white space as one space, a space before and after the text. Every stretch begins with
    the last characters of the one before, as many as reach into the next n-gram."""
    tail, space = _SPACE, False
    for piece in _pieces(text):
        chars = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        chars[chars <= 32] = 32
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
        if len(chars):
            keep[0] = not (space and chars[0] == 32)
            space = chars[-1] == 32
        chars = np.concatenate([tail, chars[keep]])
        yield chars
        tail = chars[1 - max(SIZES):]
    yield np.concatenate([tail, _SPACE])


def _spots(chars: np.ndarray) -> np.ndarray:
    """The place of every n-gram, repeated ones too."""
    known = chars * np.uint32(0x9E3779B1)
    h, spots = known, [np.zeros(0, np.uint32)]
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + known[n - 1:]
        if n in SIZES:
            spots.append((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D) >> np.uint32(12))
    return np.concatenate(spots).astype(np.int64)


def places(text: str, stamp: np.ndarray) -> np.ndarray:
    """The places of a text's n-grams, each once. `stamp`: PLACES numbers, of any value. Takes memory for a window of the
    text, whatever its length."""
    if len(text) <= WINDOW:
        found = _spots(np.append(next(_characters(text)), _SPACE))
        order = np.arange(len(found), dtype=stamp.dtype)
        stamp[found] = order  # of equal places the last one stays
        return found[stamp[found] == order]
    seen = np.zeros(PLACES, bool)
    for chars in _characters(text):
        seen[_spots(chars)] = True
    return np.flatnonzero(seen)


def new_stamp() -> np.ndarray:
    return np.zeros(PLACES, np.int64)


def fit(texts: list[str], toxic: np.ndarray, base_rate: float, how: Fit = Fit()) -> np.ndarray:
    """Weights by place, and the intercept at the end.

    Every fourth text is kept from the regression; on these its values are turned into
    probabilities (slope and intercept, by Newton's method on smoothed targets), each class
    weighing what it weighs among all labelled rows.
    """
    stamp = new_stamp()
    rows = [places(t, stamp) for t in texts]
    apart = np.arange(len(rows)) % 4 == 3
    if any(len(set(toxic[part])) < 2 for part in (apart, ~apart)):
        apart = np.zeros(len(rows), bool)
    counts = [np.full(PLACES, how.smooth), np.full(PLACES, how.smooth)]
    for i in np.flatnonzero(~apart):
        counts[toxic[i]][rows[i]] += 1
    n = np.bincount(toxic[~apart], minlength=2) + 2 * how.smooth
    ratio = np.log((counts[1] / n[1]) / (counts[0] / n[0])).astype(np.float32)
    weights, squares = np.zeros(PLACES, np.float32), np.full(PLACES, 1e-6, np.float32)
    shift = np.log(n[1] / n[0])
    xs = [ratio[row] / np.sqrt(np.float32(max(len(row), 1))) for row in rows]
    order = np.random.default_rng(how.seed)
    for _ in range(how.rounds):
        for i in order.permutation(np.flatnonzero(~apart)):
            row, x = rows[i], xs[i]
            p = 1 / (1 + np.exp(-np.clip(x @ weights[row] + shift, -30, 30)))
            g = (p - toxic[i]) * x + how.penalty * weights[row]
            squares[row] += g * g
            weights[row] -= how.step * g / np.sqrt(squares[row])
    tried = np.flatnonzero(apart) if apart.any() else np.arange(len(rows))
    values = np.array([x @ weights[row] for row, x in zip((rows[i] for i in tried), (xs[i] for i in tried))])
    slope, intercept = calibrated(values, toxic[tried], base_rate)
    return np.append(weights * ratio * slope, [intercept]).astype(np.float32)


def calibrated(values: np.ndarray, toxic: np.ndarray, base_rate: float) -> tuple[float, float]:
    """Slope and intercept of the log-odds over the classifier's values."""
    n = np.bincount(toxic, minlength=2)
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    rate = min(max(base_rate, 1e-6), 1 - 1e-6)
    weight = np.where(toxic == 1, rate / max(n[1], 1), (1 - rate) / max(n[0], 1))
    x = np.stack([values, np.ones(len(values))])
    b = np.array([1.0, np.log(rate / (1 - rate))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        slope = (x * weight * p * (1 - p)) @ x.T + 1e-9 * np.eye(2)
        step = np.linalg.solve(slope, x @ (weight * (p - target)))
        b = b - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return (max(float(b[0]), 1e-3), float(b[1]))


def score(text: str | None, weights: np.ndarray, stamp: np.ndarray) -> float:
    row = places(text or "", stamp)
    z = float(weights[row].sum(dtype=np.float64)) / np.sqrt(max(len(row), 1)) + float(weights[PLACES])
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> np.ndarray | None:
    """The weights, learnt from labelled rows that are not held out; None without toxic ones."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    sums = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not sums["toxic"]:
        return None
    first = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.per_class)
             for y in (0, 1)]
    # At most 2 * per_class ids.
    sample = docs.select("doc_id", "text").join(F.broadcast(first[0].unionAll(first[1])), "doc_id").groupBy(
        "doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        order = pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        toxic = order["toxic"].to_numpy().astype(np.int64)
        weights = fit([t or "" for t in order["text"].to_pylist()], toxic, sums["toxic"] / sums["n"], how)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    found = sample.repartition(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else None


def scores(docs: DataFrame, weights: np.ndarray | None) -> Column:
    """The score of the column `text`."""
    if weights is None:
        return F.lit(0.0)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        stamp = new_stamp()
        return pa.array([score(t, sent.value, stamp) for t in texts.to_pylist()], pa.float64())

    return run(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text)."""
    scored = docs.select("doc_id", scores(docs, train(docs, labels, how)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """The rows whose score is below 0.5."""
    return docs.filter(scores(docs, train(docs, labels, how)) < 0.5)
