"""Bootstraps by round: what a round draws is how often it takes each row, so no draw is ever a row of a table.

Every group of rounds gets the rows once, packed, and works out its rounds from them in one task. That takes groups times the rows of
shuffle and holds all rows in each worker; beyond ``MOST`` cells the caller's plain plan takes over, which joins draws with rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells, rows times numbers to a row, that a worker holds at most; and tasks that the rounds are dealt to.
MOST, GROUPS = 1 << 25, 32

#: Rows that are scored at a time.
STRETCH = 1 << 14

#: Gets all rows; gives the function from each row's number of draws to a round's values, None for a round without any.
Prepare = Callable[[pa.Table], Callable[[np.ndarray], tuple | None]]


def multiplicities(n: int, seed: int, b: int, block: int = 1) -> np.ndarray:
    """How often round ``b`` of ``classify.draws`` takes each of ``n`` places; round 0 takes each once."""
    if b == 0:
        return np.ones(n, np.int32)
    text, many = f"{seed}-{b}-%d".encode(), -(-n // block)
    starts = np.empty(many, np.int64)
    for a in range(0, many, 1 << 16):
        digests = b"".join([hashlib.md5(text % i, usedforsecurity=False).digest() for i in range(a, min(many, a + (1 << 16)))])
        starts[a : a + (1 << 16)] = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64) % max(n - block + 1, 1)
    whole = n // block
    counts = np.bincount(starts[:whole], minlength=n).astype(np.int32)
    if block > 1:
        total = np.cumsum(counts, dtype=np.int32)
        counts = total.copy()
        counts[block:] -= total[:-block]
    if whole < many:
        counts[starts[-1] : starts[-1] + n - whole * block] += 1
    return counts


def by_round(rows: DataFrame, key: str, rounds: int, seed: int, block: int, prepare: Prepare, schema: str, plain: Callable[[], DataFrame], cells: int = 1) -> DataFrame:
    """(b, columns of ``schema``) of round 0, the sample itself, and of each round of ``classify.draws`` over ``rows`` in the order of
    ``key``, a number that doesn't repeat; null keys are left out. ``cells``: numbers to a row. ``plain`` gives the same for more rows than fit."""
    rows = rows.where(F.col(key).isNotNull())
    if rows.count() * cells > MOST:
        return plain()
    packed = rows.mapInArrow(_pack, "data binary").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))

    names = ["b", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(g, data.as_buffer()) for batch in batches for data, g in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
        if not held:
            return
        group, table = held[0][0], pa.concat_tables(pa.ipc.open_stream(data).read_all() for _, data in held)
        held.clear()
        keys = table.column(key).to_numpy()
        place = np.empty(len(keys), np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        one = prepare(table.drop_columns([key]))
        del table, keys
        found = [(b, *values) for b in range(group, rounds + 1, GROUPS) if (values := one(multiplicities(len(place), seed, b, block)[place])) is not None]
        if found:
            b, *columns = zip(*found, strict=True)
            yield pa.record_batch([pa.array(b, pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], names=names)

    return packed.repartitionById(GROUPS, "g").mapInArrow(run, f"b long, {schema}")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["data"])


def percentile(values: np.ndarray, counts: np.ndarray, q: float) -> float | None:
    """The quantile ``q`` by linear interpolation of values that each stand ``counts`` times; None without any."""
    every = np.repeat(values, counts)
    if not len(every):
        return None
    at = (len(every) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    part = np.partition(every, (low, high))
    return _between(part[low], part[high], at - low)


def sorted_percentiles(values: np.ndarray, counts: np.ndarray, qs: tuple[float, ...]) -> list[float] | None:
    """As ``percentile``, of values that are in order."""
    upto = np.cumsum(counts, dtype=np.int64)
    if not len(upto) or not upto[-1]:
        return None
    at = (upto[-1] - 1) * np.array(qs)
    low, high = (values[np.searchsorted(upto, f(at), side="right")] for f in (np.floor, np.ceil))
    return [_between(a, b, r) for a, b, r in zip(low, high, at - np.floor(at), strict=True)]


def _between(a: float, b: float, rest: float) -> float:
    return float(a) if a == b else float(a + (b - a) * rest)


def mean(table: pa.Table) -> Callable[[np.ndarray], tuple | None]:
    """The mean of a column of whole numbers."""
    x = table.column(0).to_numpy().astype(np.int64)
    return lambda counts: (float(counts @ x / counts.sum()),)


def percentile_of(q: float) -> Prepare:
    """The quantile ``q`` of a column; nulls count as rows that are drawn, but not as values."""

    def prepare(table: pa.Table) -> Callable[[np.ndarray], tuple | None]:
        x = table.column(0).combine_chunks()
        kept = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        values = x.drop_null().to_numpy(zero_copy_only=False)
        order = np.argsort(values, kind="stable")
        rows, values = kept[order], values[order]
        return lambda counts: tuple(sorted_percentiles(values, counts[rows], (q,)) or (None,))

    return prepare


def thresholds(floor: float = 1e-6, part: float = 0.01, top: int = 3, q: float = 0.99) -> Prepare:
    """The quantiles ``q`` of ``detection.window_scores`` (m1, m2, m3) after ``detection.calibrate`` over the same draws.

    Columns: nodes and errors, lists of a row's nodes and their errors; the error of a node that isn't valid is null.
    """

    def prepare(table: pa.Table) -> Callable[[np.ndarray], tuple | None]:
        nodes = np.unique(np.concatenate([pc.unique(c.flatten()).to_numpy(zero_copy_only=False) for c in table.column("nodes").chunks] or [np.zeros(0, np.int64)]))
        error, valid = np.zeros((len(nodes), table.num_rows)), np.zeros((len(nodes), table.num_rows), bool)
        present, start = np.zeros((len(nodes), table.num_rows), bool), 0
        for c in table.to_batches():
            lists = c.column("nodes")
            row = start + np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at, x = np.searchsorted(nodes, lists.flatten().to_numpy(zero_copy_only=False)), c.column("errors").flatten()
            present[at, row] = True
            valid[at, row] = x.is_valid().to_numpy(zero_copy_only=False)
            error[at, row] = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
            start += len(lists)
        order = []
        for e, v in zip(error, valid, strict=True):
            rows = np.flatnonzero(v)
            order.append(rows[np.argsort(e[rows], kind="stable")].astype(np.int32))
        m1 = np.where(valid, error, -np.inf).max(0, initial=-np.inf)
        scored = valid.any(0)
        others = np.flatnonzero(~scored)
        present = present[:, others]

        def one(counts: np.ndarray) -> tuple | None:
            stats = [sorted_percentiles(e[rows], counts[rows], (0.25, 0.5, 0.75)) for e, rows in zip(error, order, strict=True)]
            iqr = np.array([np.nan if s is None else s[2] - s[0] for s in stats])
            known = np.array([s is not None for s in stats], bool)
            if not known.any():
                return None
            scale = np.maximum(iqr, max(floor, part * float(np.median(iqr[known]))))
            window = scored.copy()
            window[others] = present[known].any(0)
            drawn = np.flatnonzero((counts > 0) & window)
            m2, m3 = np.empty(len(drawn)), np.empty(len(drawn))
            for a in range(0, len(drawn), STRETCH):
                rows = drawn[a : a + STRETCH]
                z = np.full((len(rows), len(nodes)), -np.inf)
                for k in np.flatnonzero(known):
                    np.copyto(z[:, k], (error[k, rows] - stats[k][1]) / scale[k], where=valid[k, rows])
                z.partition(max(0, len(nodes) - top), axis=1)
                some = np.minimum(valid[:, rows].sum(0), top)
                best = np.sort(z[:, -top:], axis=1)[:, ::-1]
                m2[a : a + STRETCH] = best[:, 0]
                best = np.where(np.arange(best.shape[1]) < some[:, None], best, 0.0)
                m3[a : a + STRETCH] = np.where(some > 0, best.sum(1) / np.maximum(some, 1), -np.inf)
            return tuple(percentile(m, counts[drawn], q) for m in (m1[drawn], m2, m3))

        return one

    return prepare
