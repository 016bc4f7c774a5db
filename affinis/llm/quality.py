"""Quality scores by naive Bayes support vectors.

Indicators of hashed n-grams, over words and over word shapes, are scaled by the log ratio of their counts in
both classes; a linear hinge-loss model is fitted on them by dual coordinate descent, and its margins are
mapped to probabilities by a sigmoid that is fitted on documents kept aside.

Defined results: null and empty texts have no n-grams and get the score of the bias; a document with several
labels has the largest; unlabelled training (no labels, or one class) gives the share of label 1 to all, 0.5
without labels; n-grams of fewer than MIN_DOCS documents count for nothing; a text's words are found in
pieces, whose size changes no result, so memory is a few numbers for each word; repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import held_out, ready_workers, unit_hash

BITS = 18
#: The model is fitted on about so many labelled documents at most, drawn by a hash of their ids.
MAX_TRAIN_DOCS = 4000
MIN_DOCS, SMOOTHING, COST, EPOCHS, THRESHOLD = 3, 1.0, 1.0, 12, 0.3
#: Share of the training documents that the sigmoid is fitted on, every ASIDE-th.
ASIDE = 4
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
#: Kinds of characters: lower case and all beyond ASCII, upper case, digits, each other one by itself.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91], _KIND[48:58] = 2, 3
_PLACE = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, shape) of each word. A word's terms are added up, so one that goes on in the next piece is the same word."""
    sums, kinds = [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.uint64)]
    held, length = False, 0  # whether the last word may go on, and its bytes so far
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at)
        inside = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        goes_on = held and bool(inside[0])
        if len(start):
            keep = np.flatnonzero(inside)
            size = stop - start
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(len(keep)) - np.repeat(first, size)
            if goes_on:
                place[: size[0]] += length
            found = np.add.reduceat((_LOW[raw[keep]] + np.uint64(7)) * _PLACE[place & 63], first)
            second = np.where(size > 1, _KIND[raw[np.minimum(start + 1, len(raw) - 1)]], np.uint64(0))
            kind = np.stack([_KIND[raw[start]], second, _KIND[raw[stop - 1]]], 1)
            if goes_on:
                sums[-1][-1:] += found[:1]
                kinds[-1][-1, 2] = kind[0, 2]
                if length == 1:
                    kinds[-1][-1, 1] = kind[0, 0]
                found, kind = found[1:], kind[1:]
            length = int(size[-1]) + (length if goes_on and len(size) == 1 else 0)
            if len(found):
                sums.append(found)
                kinds.append(kind)
        held = bool(inside[-1])
    kind = np.concatenate(kinds)
    return _mix(np.concatenate(sums)), (kind[:, 0] << np.uint64(16)) | (kind[:, 1] << np.uint64(8)) | kind[:, 2]


def features(text: str | None, stamp: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text's n-grams: of one and two words, and of one to three shapes. ``stamp`` is scratch."""
    if not text:
        return np.zeros(0, np.int32)
    words, shapes = _words(text.encode())
    if not len(words):
        return np.zeros(0, np.int32)
    same = np.concatenate([[False], words[1:] == words[:-1]])
    shapes = _mix((shapes << np.uint64(1)) | same.astype(np.uint64))
    k = np.uint64(0x94D049BB133111EB)
    two = shapes[:-1] * k + shapes[1:]
    grams = [words, _mix(words[:-1] * k + words[1:]), shapes * k, _mix(two), _mix(two[:-1] * k + shapes[2:])]
    got = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32)
    at = np.arange(len(got), dtype=np.int32)
    stamp[got] = at
    return got[stamp[got] == at]


class Model:
    """Margins are sums over a text's features: ``weight`` for the model, ``square`` for the length that they are divided by."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weight, self.square, self.bias, self.slope, self.offset = weight, square, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        length = float(self.square[found].sum(dtype=np.float64)) ** 0.5
        return float(self.weight[found].sum(dtype=np.float64)) / max(length, 1e-9) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, over rows scaled to length 1 with a constant beside them."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    square = np.array([(v**2).sum() + 1.0 for v in values])
    cost = COST * np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y < 0).mean()))
    order = np.random.default_rng(10)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _sigmoid(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the label's log odds, with Platt's smoothed targets, by Newton steps."""
    up, down = label.sum(), (1 - label).sum()
    t = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p))
        theta = theta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """From the features and the 0/1 label of each training document."""
    size, nothing = 1 << BITS, np.zeros(1 << BITS, np.float32)
    share = (label.sum() + 0.5) / (len(label) + 1.0)
    if not len(label) or label.min() == label.max():
        return Model(nothing, nothing, 0.0, 0.0, float(np.log(share / (1 - share))) if len(label) else 0.0)
    aside = np.arange(len(label)) % ASIDE == 0
    if len(set(label[aside])) < 2 or len(set(label[~aside])) < 2:
        aside = np.zeros(len(label), bool)
    learn = np.flatnonzero(~aside)
    good, bad = np.zeros(size), np.zeros(size)
    for i in learn:
        (good if label[i] else bad)[rows[i]] += 1
    p, q = good + SMOOTHING, bad + SMOOTHING
    ratio = np.where(good + bad >= MIN_DOCS, np.log(p / (label[learn].sum() + 2 * SMOOTHING)) - np.log(q / ((1 - label[learn]).sum() + 2 * SMOOTHING)), 0.0)
    w, bias = _descend([rows[i] for i in learn], np.where(label[learn] > 0, 1.0, -1.0), ratio)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    held = np.flatnonzero(aside) if aside.any() else learn
    model.slope, model.offset = _sigmoid(np.array([model.margin(rows[i]) for i in held]), label[held].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """From the labelled documents that are not held out. At most about ``max_docs`` documents' features reach the driver."""
    spark = docs.sparkSession
    ready_workers(spark)
    known = labels.where(~held_out() & F.col(f"`{label}`").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    n = known.count()
    drawn = known.where(unit_hash(F.col("key"), seed=10) < min(1.0, max_docs / max(1, n)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("key")).select("key", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            found = pa.array([features(t, stamp) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), found], ["key", "y", "found"])

    got = chosen.mapInArrow(run, "key long, y int, found array<int>").toArrow().sort_by("key")
    found = got.column("found").combine_chunks()
    ends, values = found.offsets.to_numpy(), found.values.to_numpy()
    rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return fit(rows, got.column("y").to_numpy().astype(np.int64))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of the columns in ``keep``, score)."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            margins = np.array([shared.value.margin(features(t, stamp)) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(shared.value.score(margins), pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def assess(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Learn from the labels of documents that are not held out, and score all."""
    return predict(docs, train(docs, labels, max_docs=max_docs), keep)
