"""Toxicity by subword bags: a passage is the average of its words' vectors, a word the average of the vectors of its character
n-grams and of itself; a linear softmax over that average is trained jointly with the vectors, so an unseen misspelling shares
most vectors with the word it comes from. A text has the score of its highest passage, so length doesn't thin out what it says,
less what the highest of so many passages has by chance.
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
from .features import GOLD, held_out, mixed, sampled, tokens

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 4_000
#: Words of a passage at most; lengths of the n-grams, hashed rows of the embedding table, and its width.
PASSAGE, GRAMS, ROWS, WIDTH = 40, (4, 5, 6), 1 << 17, 4
#: Rounds of each half of the fit, how much more a positive row counts; and the factor of the average before the softmax, and decay.
#: The vectors start from the log ratio of a row's document shares in the classes, in one dimension, and small noise in the others.
FIRST, ROUNDS, POSITIVE, SCALE, DECAY = 8, 15, 1.0, 100.0, 1e-4
#: Sampled documents that a table row has to be in at least; others stay 0, as do rows that the sample lacks.
LEAST = 3
#: Texts whose bags are made, and gone through, at a time.
STRETCH = 100
#: Distinct words that a passage's average counts at least, so that one word which a passage repeats isn't taken for all of it.
EVIDENCE = 12
#: Score from which a text counts as toxic.
THRESHOLD = 0.7


class Model(NamedTuple):
    """What scoring needs: each table row's part of the log odds, the bias, and what the log of the number of passages adds."""

    rows: np.ndarray
    bias: float
    length: float = 0.0


def gram_rows(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word's n-grams, with markers for its start and end, and of the word itself; and where each word's start."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    framed = pc.binary_join_element_wise("<", words, ">", "")
    sizes = pc.utf8_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(framed.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bounds = starts_of(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    room = bounds[1:][word] - np.arange(len(points))
    value, keys, owners = np.zeros(len(points), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        value = value * np.uint64(0x100000001B3)
        value[: len(points) - n + 1] += points[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            keys.append(value[at] + GOLD * np.arange(n, n + 1, dtype=np.uint64))
            owners.append(word[at])
    place = (np.arange(len(points)) - bounds[:-1][word]).astype(np.uint64)
    whole = np.add.reduceat(mixed(points + place * GOLD), bounds[:-1])
    keys.append(whole)
    owners.append(np.arange(len(sizes)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = (mixed(key[order]) >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)
    return rows, starts_of(np.bincount(owner, minlength=len(sizes)))


def passages(bounds: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cuts each text into passages of at most ``most`` words, of nearly one length: bounds of the words, and of the texts' passages.

    A text without words is one empty passage.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // (most or PASSAGE)))
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - starts_of(counts)[:-1][text]
    return np.append(bounds[:-1][text] + sizes[text] * place // counts[text], bounds[-1]), starts_of(counts)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weights and bounds of each passage's bag, the mean over its distinct words of the mean over a word's table rows; and passages per text."""
    words, codes, bounds = tokens(texts, lower=True)
    rows, starts = gram_rows(words)
    bounds, parts = passages(bounds)
    out_rows, out_weights, sizes = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        distinct = np.unique(codes[a:b])
        lengths = starts[distinct + 1] - starts[distinct]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[distinct] - (ends - lengths), lengths)
        found, place = np.unique(rows[at], return_inverse=True)
        out_rows.append(found.astype(np.int32))
        out_weights.append(np.bincount(place, np.repeat(SCALE / lengths / max(EVIDENCE, len(distinct)), lengths), len(found)).astype(np.float32))
        sizes.append(len(found))
    return np.concatenate([*out_rows, np.zeros(0, np.int32)]), np.concatenate([*out_weights, np.zeros(0, np.float32)]), starts_of(np.array(sizes, np.int64)), np.diff(parts)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the columns of ``x``, and the offset, of the logistic model of ``y``, by damped Newton steps on standardised columns."""
    mid, wide = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mid) / wide, np.ones(len(x))])
    c, ridge = np.r_[1.0, np.zeros(x.shape[1])], np.r_[np.full(x.shape[1], 1e-2), 1e-3]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + np.r_[ridge[:-1], 0] * c)
        c = c - np.clip(step, -1, 1)
        if np.abs(step).sum() < 1e-6:
            break
    c[:-1] /= wide
    c[-1] -= c[:-1] @ mid
    return c


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Trains embeddings and softmax jointly by L-BFGS, on passages. Without five texts of each label the model gives every text the share of label 1, or 0.5.

    At first each passage has its text's label. After ``FIRST`` rounds, the passages of a positive text that score below one half are
    left out, but for its highest: they are its clean parts. The score of a text is a logistic model of its highest passage and of
    the log of their number.
    """
    labels = np.array([r[1] for r in rows], np.float64)
    if min(labels.sum(), len(labels) - labels.sum()) < 5:
        p = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(ROWS, np.float32), float(np.log(p / (1 - p))))
    parts, passes, good, bad = [], [], np.zeros(ROWS), np.zeros(ROWS)
    for k in range(0, len(rows), STRETCH):
        at, weight, bounds, counts = bags(pa.array([t for t, _ in rows[k : k + STRETCH]], pa.string()))
        once = np.unique(np.repeat(np.repeat(np.arange(len(counts)), counts), np.diff(bounds)) * ROWS + at)
        positive = labels[k : k + STRETCH][once // ROWS] > 0
        good += np.bincount((once % ROWS)[~positive], minlength=ROWS)
        bad += np.bincount((once % ROWS)[positive], minlength=ROWS)
        parts.append((at, weight.astype(np.float16), bounds))
        passes.append(counts)
        del once, positive, weight
    trim()
    counts = np.concatenate(passes)
    text, y, known = np.repeat(np.arange(len(labels)), counts), np.repeat(labels, counts), good + bad >= LEAST
    for at, weight, _ in parts:
        weight *= known[at]
    first = starts_of(np.array([len(b) - 1 for _, _, b in parts]))
    stretches = [(a, b, *part) for a, b, part in zip(first[:-1], first[1:], parts, strict=True)]

    def margins(each: np.ndarray) -> np.ndarray:
        return np.concatenate([sums_of(each[at] * weight, bounds) for _, _, at, weight, bounds in stretches])

    def gathered(miss: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at, weight * np.repeat(miss[a:b], np.diff(bounds)), ROWS) for a, b, at, weight, bounds in stretches)

    random = np.random.default_rng(seed)
    table, out = random.normal(0, 0.01, (ROWS, WIDTH)), random.normal(0, 0.01, (WIDTH, 2))
    ratio = np.log((bad + 0.5) / (labels.sum() + 1)) - np.log((good + 0.5) / (len(labels) - labels.sum() + 1))
    table[:, 0] += np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))
    table[~known] = 0
    slope, offset = logistic(margins(table[:, 0])[:, None], y)
    scale = np.sqrt(abs(slope))
    table[:, 0] *= scale
    out[0] += [-slope / scale / 2, slope / scale / 2]
    share = np.where(y > 0, POSITIVE, 1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        table, out, bias = x[: ROWS * WIDTH].reshape(ROWS, WIDTH), x[ROWS * WIDTH : -2].reshape(WIDTH, 2), x[-2:]
        way = out[:, 1] - out[:, 0]
        z = margins(table @ way) + bias[1] - bias[0]
        part = share / share.sum()
        miss = part * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        seen = gathered(miss)
        pull = table.T @ seen
        grad = np.concatenate([(np.outer(seen, way) + DECAY * table * known[:, None]).ravel(), (np.stack([-pull, pull], 1) + DECAY * out).ravel(), [-miss.sum(), miss.sum()]])
        return float((part * (np.logaddexp(0, z) - y * z)).sum() + DECAY / 2 * ((table * table).sum() + (out * out).sum())), grad

    x = np.concatenate([table.ravel(), out.ravel(), [-offset / 2, offset / 2]])
    for turn in range(2):
        x = lbfgs(loss, x, ROUNDS if turn else FIRST)
        way = x[ROWS * WIDTH : -2].reshape(WIDTH, 2) @ [-1.0, 1.0]
        each = x[: ROWS * WIDTH].reshape(ROWS, WIDTH) @ way
        z = margins(each) + x[-1] - x[-2]
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, text, z)
        share[(y > 0) & (z < 0) & (z < top[text])] = 0
    slope, length, offset = logistic(np.column_stack([top, np.log(counts)]), labels)
    offset += np.log((len(labels) - labels.sum()) / labels.sum())  # as likely as if both labels were as frequent
    return Model((slope * SCALE * each).astype(np.float32), float(slope * (x[-1] - x[-2]) + offset), float(length))


def lbfgs(loss, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Minimises a smooth function, given with its gradient, by the two-loop recursion and a halving line search."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, marks = -grad, []
        for s, y, r in reversed(steps):
            marks.append(r * (s @ way))
            way = way - marks[-1] * y
        if steps:
            s, y, r = steps[-1]
            way = way / (r * (y @ y))
        else:
            way = way / max(1e-12, np.abs(way).max())
        for (s, y, r), m in zip(steps, reversed(marks), strict=True):
            way = way + (m - r * (y @ way)) * s
        slope, size = grad @ way, 1.0
        while size > 1e-6:
            new, new_grad = loss(x + size * way)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * way, new_grad - grad
        x, done = x + s, value - new < 1e-7
        value, grad = new, new_grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))] if len(steps) >= memory else [*steps, (s, y, 1 / (s @ y))]
        if done:
            break
    return x


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 of each text, that of its highest passage; a text without words has that of the bias."""
    words, codes, bounds = tokens(texts, lower=True)
    rows, starts = gram_rows(words)
    each = sums_of(model.rows[rows], starts) / np.maximum(np.diff(starts), 1)
    bounds, parts = passages(bounds)
    spot = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * max(1, len(words)) + codes)
    inside = starts_of(np.bincount(spot // max(1, len(words)), minlength=len(bounds) - 1))
    z = sums_of(each[spot % max(1, len(words))], inside) / np.maximum(np.diff(inside), EVIDENCE) + model.bias
    top = np.maximum.reduceat(z, parts[:-1]) + model.length * np.log(np.diff(parts)) if len(texts) else z
    return 1 / (1 + np.exp(-np.clip(top, -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of at most ``bound`` labelled documents whose id's crc32 mod 3 isn't 1. A task fits it, so the driver gets only the model."""
    found = sampled(docs, labels, "toxic", bound, held_out(F.col("doc_id"), 3, 1), id_col, text_col)
    fitted = [] if found is None else found.repartition(1).sortWithinPartitions("id").select("t", "y").mapInArrow(_fitted, "rows binary, bias double, length double").collect()
    return Model(np.frombuffer(fitted[0].rows, np.float32), fitted[0].bias, fitted[0].length) if fitted else fit([])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = fit([row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
    trim()
    yield pa.record_batch([pa.array([model.rows.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.length])], names=["rows", "bias", "length"])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the row key, held_out, score and predicted (1 if the score is at least ``THRESHOLD``).

    Null and empty texts have the score of a text without words. Ids may be null (held_out by the crc32 of an empty text) or repeat; each
    row is scored by itself. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 1, 2 << 20):
                yield pa.record_batch([part.column(0), part.column(2), pa.array(scores(shared.value, part.column(1)))], names=["doc_id", KEY, "score"])
            trim()

    found = picked(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {KEY} long, score double")
    return found.select("doc_id", KEY, held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


