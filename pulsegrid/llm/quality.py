"""Quality by Naive Bayes support vectors: indicators of n-grams, scaled by the log-count ratio of the classes, and a linear
hinge-loss model over them, fitted by dual coordinate descent.

The n-grams are words and pairs of words, and runs of one to three word shapes (letters as x or X, digits as 9, marks as they are,
= for a word that repeats the one before), so they carry over to words that the sample lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, chunks, picked, starts_of, sums_of, trim
from .features import GOLD, hashed, held_out, mixed, sample, tokens

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 6_000
#: Hashed features, smoothing of the counts, and cost and passes of the descent.
ROWS, ALPHA, COST, PASSES = 1 << 20, 1.0, 1.0, 12
#: Score from which a text counts as good.
THRESHOLD = 0.3


class Model(NamedTuple):
    """A coefficient per hashed feature, the bias, and slope and offset of the score's sigmoid."""

    rows: np.ndarray
    bias: float
    slope: float
    offset: float


def shapes(words: pa.Array) -> pa.Array:
    out = words
    for pattern, to in ((r"\p{Ll}+", "x"), (r"\p{Lu}{2,}", "XX"), (r"\p{Lu}", "X"), (r"X{3,}", "XX"), (r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "o"), (r"\p{N}+", "9"), (r"(?:x9|9x){2,}", "x9")):
        out = pc.replace_substring_regex(out, pattern, to)
    return pc.utf8_slice_codeunits(out, 0, 8)


def features(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features that each text has, without repeats, and where each text's start; with ``keep`` only features it marks."""
    words, codes, bounds = tokens(texts, lower=False)
    n, size = len(codes), len(bounds) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(size + 1, np.int64)
    owner = np.repeat(np.arange(size), np.diff(bounds))
    inner = np.zeros(n, bool)
    inner[1:] = owner[1:] == owner[:-1]
    again = np.zeros(n, bool)
    again[1:] = (codes[1:] == codes[:-1]) & inner[1:]
    word, shape = hashed(words)[codes], hashed(shapes(words))[codes] + again.astype(np.uint64) * GOLD
    two, three = np.flatnonzero(inner), np.flatnonzero(inner[1:] & inner[:-1]) + 1
    prime = np.uint64(0xC2B2AE3D27D4EB4F)
    grams = (
        (word, np.arange(n)), (word[two - 1] * prime + word[two], two), (shape + np.uint64(1), np.arange(n)), (shape[two - 1] * prime + shape[two] + np.uint64(2), two),
        ((shape[three - 2] * prime + shape[three - 1]) * prime + shape[three] + np.uint64(3), three),
    )
    out = []
    for value, at in grams:
        row = (mixed(value) >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)
        if keep is not None:
            on = keep[row]
            row, at = row[on], at[on]
        out.append(owner[at] * ROWS + row)
    pairs = np.unique(np.concatenate(out))
    return pairs % ROWS, starts_of(np.bincount(pairs // ROWS, minlength=size))


def descend(at: np.ndarray, values: np.ndarray, bounds: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: dual coordinate descent, a row at a time in random order."""
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
    norms = sums_of(values[: bounds[-1]] ** 2, bounds) + 1
    random = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in random.permutation(len(y)):
            a, b = bounds[i], bounds[i + 1]
            rows, v = at[a:b], values[a:b]
            slope = y[i] * (w[rows] @ v + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), cost[i])
            if (step := (new - dual[i]) * y[i]) != 0:
                w[rows] += step * v
                bias += step
                most = max(most, abs(step))
            dual[i] = new
        if most < 1e-3:
            break
    return w, bias


def sigmoid_of(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits margins to labels best, by Newton's method."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, v = p - goal, p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(r * margin).sum(), r.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fits on four fifths of the rows and the score's sigmoid on the rest. Without five rows of each label every text gets the share of label 1, or 0.5."""
    rows = [r for k, r in enumerate(rows) if k % 5 != 4] + rows[4::5]
    y, fitted = np.array([r[1] for r in rows], np.int64), len(rows) - len(rows) // 5
    if min(np.bincount(y, minlength=2)[:2], default=0) < 5:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(ROWS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    parts = [features(pa.array([t for t, _ in rows[k : k + 250]], pa.string())) for k in range(0, len(rows), 250)]
    at, bounds = np.concatenate([p[0].astype(np.int32) for p in parts]), starts_of(np.concatenate([np.diff(p[1]) for p in parts]))
    del parts
    known = np.bincount(at, minlength=ROWS) >= 3
    on = known[at]
    bounds = starts_of(on.astype(np.int64))[bounds]
    at = at[on]
    good = []
    for k in (0, 1):
        own = np.repeat(y[:fitted] == k, np.diff(bounds[: fitted + 1]))
        good.append(np.bincount(at[: bounds[fitted]][own], minlength=ROWS) + ALPHA)
    ratio = np.log(good[1] / ((y[:fitted] == 1).sum() + 2 * ALPHA)) - np.log(good[0] / ((y[:fitted] == 0).sum() + 2 * ALPHA))
    ratio[~known] = 0
    values = (ratio[at] / np.repeat(np.sqrt(np.maximum(np.diff(bounds), 1)), np.diff(bounds))).astype(np.float32)
    cost = np.where(y == 1, COST * len(y) / (2 * y.sum()), COST * len(y) / (2 * (len(y) - y.sum())))
    w, bias = descend(at, values, bounds[: fitted + 1], np.where(y[:fitted] == 1, 1.0, -1.0), cost, ROWS)
    margin = (sums_of(w[at] * values, bounds) + bias)[fitted:]
    rows = w * ratio
    rows[known & (rows == 0)] = 1e-20  # known features count in the norm
    return Model(rows.astype(np.float32), bias, *sigmoid_of(margin, y[fitted:]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """A score from 0 to 1, higher the likelier label 1; a text without features has that of the bias."""
    rows, bounds = features(texts, model.rows != 0)
    margin = sums_of(model.rows[rows], bounds) / np.sqrt(np.maximum(np.diff(bounds), 1)) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of at most ``bound`` labelled documents whose id's crc32 mod 5 isn't 0."""
    model = fit(sample(docs, labels, "quality", bound, held_out(F.col("doc_id"), 5, 0), id_col, text_col))
    trim()
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the row key, held_out, score and predicted (1 if the score is at least ``THRESHOLD``).

    Null and empty texts have the score of a text without features. Ids may be null (held_out by the crc32 of an empty text) or repeat;
    each row is scored by itself. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 1, 2 << 20):
                yield pa.record_batch([part.column(0), part.column(2), pa.array(scores(shared.value, part.column(1)))], names=["doc_id", KEY, "score"])
            trim()

    found = picked(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {KEY} long, score double")
    return found.select("doc_id", KEY, held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
