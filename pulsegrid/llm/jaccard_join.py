"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each document becomes a set of hashed word shingles and a MinHash signature. Documents with equal sets are one class.
2. Bands of the signature bring candidates together. Star edges in each band's bucket give groups that hold every candidate pair.
3. Within a group, signatures are compared a few values at a time; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is below the tolerance. The pairs that remain are verified on the whole shingle sets.
4. Links are counted per class, and a spanning forest of them per task gives the connected components.

A group with more classes than a tile holds is dealt to pairs of tiles, so no task gets more than two tiles, and a task returns
counts and a forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, OWN, chunks, components, keyed, picked, starts_of, trim, written
from .features import GOLD, hashed, mixed

#: Words of a shingle, similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Bands and MinHash values in each: a pair of similarity 0.8 shares no band with probability 7e-6.
BANDS, ROWS = 30, 5
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-6
#: Classes of a group that one tile holds.
TILE = 512

SEEDS = np.random.default_rng(20240607).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
SEEDS[0] |= np.uint32(1)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text, sorted and without repeats, and where each text's start.

    Words are runs of letters, digits and underscores, lower-cased. A text of fewer words is one shingle of all of them; one without
    words has none.
    """
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}_]+", " "), " ")
    split = pc.split_pattern(plain, " ")
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[(pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0)] *= -1  # splitting "" gives one empty word
    value = mixed(hashed(flat.dictionary))[codes] if len(codes) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        size = abs(n)
        w = value[at : at + size]
        at += size
        if n <= 0:
            out.append(w[:0])
            continue
        k = min(words, n)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + w[j : n - k + 1 + j]
        out.append(np.unique(mixed(h)))
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), starts_of(sizes)


def signature(values: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes; those of the empty set are the largest number."""
    low, out = (values >> np.uint64(32)).astype(np.uint32)[None, :], np.full(SEEDS.shape[1], 0xFFFFFFFF, np.uint32)
    for k in range(0, low.shape[1], 2048):
        part = low[:, k : k + 2048] * SEEDS[0][:, None]
        part += SEEDS[1][:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(1), out=out)
    return out


def set_digest(values: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(values.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, set, bands) of each document: digest of its shingle set, a hash per band (none for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 1, 4 << 20):
                values, bounds = shingles(part.column(1))
                sets, bands = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    sets.append(set_digest(values[a:b]))
                    if a == b:
                        bands.append([])
                        continue
                    rows = signature(values[a:b]).reshape(BANDS, ROWS).astype(np.uint64)
                    h = np.arange(BANDS, dtype=np.uint64) * GOLD
                    for j in range(ROWS):
                        h = mixed(h + rows[:, j])
                    bands.append(h.view(np.int64))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "key", "set", "bands"])
            trim()

    return picked(docs, id_col, text_col).mapInArrow(run, "id long, key long, set binary, bands array<long>")


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, total: int = BANDS * ROWS) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed) after each step: with fewer, the posterior of similarity >= threshold, from a uniform prior, is below the tolerance."""
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            # The posterior of m matches in n is Beta(m + 1, n - m + 1); its tail is a binomial sum.
            tail = sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if tail >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two signature blocks that no step drops; with ``same`` only those above the diagonal."""
    left, right, found = [], [], least_matches()
    first, need = found[0]
    for i in range(len(a)):
        start = i + 1 if same else 0
        j = np.flatnonzero((b[start:, :first] == a[i, :first]).sum(1) >= need) + start
        left.append(np.full(len(j), i))
        right.append(j)
    i, j = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
    matched = np.concatenate([(a[i[k : k + 50_000], :first] == b[j[k : k + 50_000], :first]).sum(1) for k in range(0, len(i), 50_000)] + [np.zeros(0, np.int64)])
    for (before, _), (n, need) in zip(found, found[1:], strict=False):
        if len(i):
            matched = matched + np.concatenate([(a[i[k : k + 50_000], before:n] == b[j[k : k + 50_000], before:n]).sum(1) for k in range(0, len(i), 50_000)])
            on = matched >= need
            i, j, matched = i[on], j[on], matched[on]
    return i, j


def verified(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (i, j) of sets reach the threshold, by exact intersections."""
    if not len(i):
        return np.zeros(0, bool)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    common = np.zeros(len(i), np.int64)
    if len(i) < 4 * (len(a) + len(b)):
        common[:] = [len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    else:  # dense: products of 0/1 matrices over stretches of the shingles that both sides have
        fa, fb = np.concatenate(a), np.concatenate(b)
        vocabulary = np.intersect1d(fa, fb)
        oa, ob = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        pa_, pb_ = np.searchsorted(vocabulary, fa), np.searchsorted(vocabulary, fb)
        ka = (pa_ < len(vocabulary)) & (vocabulary[np.minimum(pa_, max(0, len(vocabulary) - 1))] == fa) if len(vocabulary) else np.zeros(len(fa), bool)
        kb = (pb_ < len(vocabulary)) & (vocabulary[np.minimum(pb_, max(0, len(vocabulary) - 1))] == fb) if len(vocabulary) else np.zeros(len(fb), bool)
        pa_, oa, pb_, ob = pa_[ka], oa[ka], pb_[kb], ob[kb]
        whole = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, len(vocabulary), 4096):
            width = min(4096, len(vocabulary) - k)
            ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            sa, sb = (pa_ >= k) & (pa_ < k + width), (pb_ >= k) & (pb_ < k + width)
            ma[oa[sa], pa_[sa] - k] = 1
            mb[ob[sb], pb_[sb] - k] = 1
            whole += ma @ mb.T
        common = whole[i, j].astype(np.int64)
    # exact in integers: common / union >= threshold
    per = round(threshold * 1000)
    return 1000 * common >= per * (na[i] + nb[j] - common)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, as pairs of places."""
    up, out = list(range(n)), []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = x, y
        while up[rx] != rx:
            up[rx] = up[up[rx]]
            rx = up[rx]
        while up[ry] != ry:
            up[ry] = up[up[ry]]
            ry = up[ry]
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Links within a tile, or between two: a count per class and a forest. Rows: tile a and b of the task, own tile, class, size, sets."""
    one, two = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    own, rep, size = (table.column(c).to_numpy() for c in ("tile", "rep", "size"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    order = np.argsort(rep)
    left, right = [k for k in order if own[k] == one], [k for k in order if own[k] == two]
    sa, sb = [sets[k] for k in left], [sets[k] for k in right]
    ga = np.array([signature(x) for x in sa], np.uint32).reshape(len(sa), -1)
    gb = ga if one == two else np.array([signature(x) for x in sb], np.uint32).reshape(len(sb), -1)
    i, j = survivors(ga, gb, one == two)
    on = verified(sa, sb, i, j)
    i, j, left, right = i[on], j[on], np.array(left, np.int64), np.array(right, np.int64)
    gi, gj = left[i], right[j]
    links = np.bincount(gi, minlength=len(rep)) + np.bincount(gj, minlength=len(rep))
    docs = np.bincount(gi, size[gj], len(rep)) + np.bincount(gj, size[gi], len(rep))
    touched = np.flatnonzero(links)
    tree = forest(len(rep), gi, gj)
    a = np.concatenate([rep[touched], rep[[x for x, _ in tree]] if tree else rep[:0]])
    b = pa.array([None] * len(touched) + [int(rep[y]) for _, y in tree], pa.int64())
    zeros = np.zeros(len(tree), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": np.concatenate([links[touched], zeros]), "docs": np.concatenate([docs[touched].astype(np.int64), zeros])})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(rep, shingles) of documents (rep, text): the whole shingle set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 1, 4 << 20):
                values, bounds = shingles(part.column(1))
                yield pa.record_batch([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["rep", "shingles"])
            trim()

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the row key, class_id, n_links, set_class, set_size and first.

    Documents link when the Jaccard similarity of their shingle sets is at least ``THRESHOLD``. ``n_links`` is the number of other
    documents that a document links to, copies included; ``class_id`` is the smallest doc_id of its connected component (null if
    all its ids are null), ``set_class`` that of the documents with its very set, ``set_size`` their number, and ``first`` marks
    one document of each component: the one with the smallest id, a null id last, then the first row. Texts without words have
    no shingles: they are one class of their own. A null text counts as empty. Ids may be null or repeat; each row is a document.
    An empty table gives no rows. Other columns are ignored.
    """
    low = lambda c: F.min(F.struct(F.col(c).isNull().alias("z"), F.col(c).alias("id"), F.col("key"))).alias("low")
    df = docs if KEY in docs.columns else keyed(docs)
    rows = written(profiles(df, id_col, text_col), "jaccard-profiles")
    classes = rows.groupBy("set").agg(F.count("*").alias("size"), low("id"), F.any_value("bands").alias("bands"))
    classes = written(classes.select("set", "size", F.col("low.key").alias("rep"), F.col("low.id").alias("set_class"), "bands"), "jaccard-classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("b")).where("n > 1").select("band", "b")
    groups = written(components(banded.join(buckets, "band").select(F.col("rep").alias("a"), "b"), "jaccard-groups"), "jaccard-grouped")
    sizes = groups.groupBy("root").agg(F.count("*").alias("members")).withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    members = groups.join(sizes, "root").join(classes.select("rep", "size"), groups["node"] == F.col("rep"))
    members = members.select("root", "rep", "size", "tiles", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("tile"))
    texts = picked(df, id_col, text_col).select(F.col(KEY).alias("rep"), F.col(OWN + "text").alias("text"))
    sets = shingle_sets(texts.join(groups.select(F.col("node").alias("rep")), "rep", "left_semi"))
    dealt = members.join(sets, "rep").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("root", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"), "tile", "rep", "size", "shingles")
    found = written(dealt.groupBy("root", "ta", "tb").applyInArrow(_tile, "a long, b long, links long, docs long"), "jaccard-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("docs").alias("docs"))
    linked = components(found.where("b is not null").select("a", "b"), "jaccard-linked")
    best = classes.join(counts, "rep", "left").join(linked.select(F.col("node").alias("rep"), "root"), "rep", "left")
    best = best.select("set", "size", "set_class", "rep", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("root", "rep").alias("root"))
    tops = best.groupBy("root").agg(F.min(F.struct(F.col("set_class").isNull().alias("z"), F.col("set_class").alias("id"), F.col("rep").alias("key"))).alias("top"))
    best = best.join(tops, "root").select("set", "size", "set_class", "docs", F.col("top.id").alias("class_id"), F.col("top.key").alias("top_key"))
    out = rows.select("id", "key", "set").join(best, "set")
    return out.select(F.col("id").alias("doc_id"), F.col("key").alias(KEY), "class_id", (F.col("docs") + F.col("size") - 1).alias("n_links"), "set_class", F.col("size").alias("set_size"), (F.col("key") == F.col("top_key")).alias("first"))
