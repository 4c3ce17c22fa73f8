"""Exact dedup by a Cuckoo-filter index over the digests of normalised texts.

A bucket of the index holds a Cuckoo filter and the digests it stands for. A digest that the filter doesn't know is new; one
that it may know is verified against the bucket's digests. Digests can be inserted and deleted; a filter that overflows is
built anew, twice as large, from the stored digests.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, chunks, picked, written

#: Characters that the normalised text leaves out: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: Documents per bucket of the index, on average: what one task holds.
ROWS_PER_BUCKET = 50_000
SLOTS, KICKS = 4, 200


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots; 0 is an empty slot."""

    def __init__(self, capacity: int = 64):
        self.mask = (1 << max(2, math.ceil(math.log2(max(1, capacity) / SLOTS / 0.9)))) - 1
        self.table = array("H", bytes(2 * SLOTS * (self.mask + 1)))

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = (int.from_bytes(digest[:2], "little") % 65535) + 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, mark: int) -> int:
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[k] == mark:
                return k
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        return self._slot(first, mark) >= 0 or self._slot(second, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False where the filter overflows; the caller then builds a larger one, as a mark may have been pushed out."""
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            if (k := self._slot(bucket, 0)) >= 0:
                self.table[k] = mark
                return True
        bucket = first
        for turn in range(KICKS):
            k = bucket * SLOTS + (turn + mark) % SLOTS
            self.table[k], mark = mark, self.table[k]
            bucket = self.other(bucket, mark)
            if (free := self._slot(bucket, 0)) >= 0:
                self.table[free] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            if (k := self._slot(bucket, mark)) >= 0:
                self.table[k] = 0
                return True
        return False


class CuckooIndex:
    """Live digests, each with a value; the filter decides which need to be looked up in the content at all."""

    def __init__(self, capacity: int = 64):
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, dict[bytes, object]] = {}
        self.live = self.resized = self.false_hits = 0

    def get(self, digest: bytes):
        if digest not in self.filter:
            return None
        held = self.content.get(digest[:2], {}).get(digest)
        self.false_hits += held is None
        return held

    def insert(self, digest: bytes, value) -> None:
        """Adds a digest, or gives a known one another value."""
        known = self.get(digest) is not None
        self.content.setdefault(digest[:2], {})[digest] = value
        if known:
            return
        self.live += 1
        if not self.filter.insert(digest):
            self._resize()

    def _resize(self) -> None:
        size = 2 * SLOTS * (self.filter.mask + 1)
        while True:
            self.resized += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for held in self.content.values() for d in held):
                return
            size *= 2

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; False, and nothing done, for one that isn't live."""
        if self.get(digest) is None:
            return False
        held = self.content[digest[:2]]
        del held[digest]
        if not held:
            del self.content[digest[:2]]
        self.live -= 1
        return self.filter.delete(digest)

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((d, v) for held in self.content.values() for d, v in held.items())


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def local_groups(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """A row for each digest and stretch of documents: its documents, and the best of them.

    Pre-aggregates before the shuffle: a text with a third of all rows is a few rows here, none of them longer than a stretch.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1, 8 << 20):
                ids, keys, sizes = part.column(0).to_pylist(), part.column(2).to_pylist(), pc.utf8_length(part.column(1)).to_pylist()
                found: dict[bytes, list[int]] = {}
                for row, text in enumerate(part.column(1).to_pylist()):
                    found.setdefault(hashlib.sha256(normalised(text)).digest(), []).append(row)
                best = [min(rows, key=lambda r: (-sizes[r], ids[r] is None, ids[r] or 0, keys[r])) for rows in found.values()]
                yield pa.record_batch(
                    [
                        pa.array([int.from_bytes(d[:4], "big") % buckets for d in found], pa.int32()), pa.array(list(found), pa.binary()), pa.array([len(r) for r in found.values()], pa.int64()),
                        pa.array([sizes[r] for r in best], pa.int64()), pa.array([ids[r] for r in best], pa.int64()), pa.array([keys[r] for r in best], pa.int64()),
                        pa.array([[ids[r] for r in rows] for rows in found.values()], pa.list_(pa.int64())), pa.array([[keys[r] for r in rows] for rows in found.values()], pa.list_(pa.int64())),
                    ],
                    names=["bucket", "digest", "n", "chars", "best_id", "best_key", "ids", "keys"],
                )

    return picked(docs, id_col, text_col).mapInArrow(run, "bucket int, digest binary, n long, chars long, best_id long, best_key long, ids array<long>, keys array<long>")


def resolve(groups: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_key, group_size) of each digest, through each bucket's Cuckoo index.

    A digest's stretches are put together before the index, so a text in a third of all documents is one row of its bucket.
    """

    def run(table: pa.Table) -> pa.Table:
        index = CuckooIndex(64)
        for digest, n, chars, one, key in zip(*(table.column(c).to_pylist() for c in ("digest", "n", "chars", "best_id", "best_key")), strict=True):
            mine = (-chars, one is None, one or 0, key, n)
            held = index.get(digest)
            index.insert(digest, mine if held is None else (*min(held[:4], mine[:4]), held[4] + n))
        digests, values = zip(*index.items(), strict=True) if index.live else ((), ())
        return pa.table(
            {
                "digest": pa.array(digests, pa.binary()), "keep_id": pa.array([None if v[1] else v[2] for v in values], pa.int64()), "keep_key": pa.array([v[3] for v in values], pa.int64()),
                "group_size": pa.array([v[4] for v in values], pa.int64()),
            }
        )

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("best_id").isNull().alias("z"), F.col("best_id").alias("id"), F.col("best_key").alias("key"))).alias("best")
    one = groups.groupBy("bucket", "digest").agg(F.sum("n").alias("n"), best)
    one = one.select("bucket", "digest", "n", (-F.col("best.c")).alias("chars"), F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key"))
    return one.groupBy("bucket").applyInArrow(run, "digest binary, keep_id long, keep_key long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the row key, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical without the characters of ``WHITE``. Of equal ones the longest original text, by code
    points, stays, then the smallest id (a null id last), then the first row. A null text counts as empty; all empty texts are
    one group. Rows that repeat an id each count, and one of them stays. An empty table gives no rows. Other columns are ignored.
    """
    buckets = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    groups = written(local_groups(docs, id_col, text_col, buckets), "dedup-groups")
    found = groups.select("digest", "ids", "keys").join(resolve(groups), "digest")
    rows = found.select(F.explode(F.arrays_zip("ids", "keys")).alias("d"), "keep_id", "keep_key", "group_size", "digest")
    return rows.select(F.col("d.ids").alias("doc_id"), F.col("d.keys").alias(KEY), "keep_id", "group_size", (F.col("d.keys") == F.col("keep_key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index (bucket, digests, refs, filter, slots) after ``changes`` (bucket, digest, delta): a digest lives while its references are above 0.

    ``index`` may be empty. Deleting a digest that isn't live does nothing. The filter column is the Cuckoo table's bytes.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, live = table.column("bucket")[0].as_py(), CuckooIndex(64)
        for digests, refs, digest, delta in sorted(zip(*(table.column(c).to_pylist() for c in ("digests", "refs", "digest", "delta")), strict=True), key=lambda r: r[2] or b""):
            for d, n in [*zip(digests or (), refs or (), strict=True)] + ([(digest, delta)] if digest is not None else []):
                now = (live.get(d) or 0) + (n or 0)
                if now > 0:
                    live.insert(d, now)
                else:
                    live.delete(d)
        pairs = sorted(live.items())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "digests": pa.array([[d for d, _ in pairs]], pa.list_(pa.binary())), "refs": pa.array([[n for _, n in pairs]], pa.list_(pa.int64())), "filter": pa.array([live.filter.table.tobytes()], pa.binary()), "slots": pa.array([len(live.filter.table)], pa.int64())})

    summed = changes.groupBy("bucket", "digest").agg(F.sum("delta").alias("delta"))
    rows = index.select("bucket", "digests", "refs").unionByName(summed, allowMissingColumns=True)
    return rows.groupBy("bucket").applyInArrow(run, INDEX_SCHEMA)


INDEX_SCHEMA = "bucket int, digests array<binary>, refs array<long>, filter binary, slots long"


def probe_index(index: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, seen) for each row of ``digests`` (bucket, digest); filter hits are verified against the stored digests."""

    def run(table: pa.Table) -> pa.Table:
        held, ask = None, []
        for digests, packed, digest in zip(*(table.column(c).to_pylist() for c in ("digests", "filter", "digest")), strict=True):
            if packed is not None:
                held = CuckooIndex()
                held.filter.table = array("H", packed)
                held.filter.mask = len(held.filter.table) // SLOTS - 1
                for d in digests:
                    held.content.setdefault(d[:2], {})[d] = 1
            elif digest is not None:
                ask.append(digest)
        return pa.table({"digest": pa.array(ask, pa.binary()), "seen": pa.array([held is not None and held.get(d) is not None for d in ask], pa.bool_())})

    rows = index.select("bucket", "digests", "filter").unionByName(digests.select("bucket", "digest"), allowMissingColumns=True)
    return rows.groupBy("bucket").applyInArrow(run, "digest binary, seen boolean")


