"""What the operators share: the shared folder, row keys, text chunks and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import shared_dir

#: Internal columns start with this, so that no input column clashes with them.
OWN = "__pg_"
KEY = OWN + "key"


#: Paths in the shared folder that this driver has given out, in order.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one run's files in the shared folder."""
    _made.append(f"{shared_dir(spark)}/pulsegrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as a Parquet table in the shared folder, which outlives any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete this application's files in the shared folder; results that read them must be written before."""
    _delete(spark, f"{shared_dir(spark)}/pulsegrid/{spark.sparkContext.applicationId}")
    _made.clear()


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes what is stored inside the block once it ends, but for the table that it gives to the function it gets, which returns it.

    Only a table that is written whole inside the block may be read after it.
    """
    start, kept = len(_made), []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(_made[-1])
        return table

    yield keep
    for path in _made[start:]:
        if path not in kept:
            _delete(spark, path)
    _made[start:] = [p for p in _made[start:] if p in kept]


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file of the shared folder; a repeated task replaces it by the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_bytes(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def _only_reads(plan) -> bool:
    """Whether a plan does nothing but read, select and filter stored rows."""
    if plan.nodeName() not in ("Project", "Filter", "LogicalRelation", "Relation", "View", "SubqueryAlias"):
        return False
    return all(_only_reads(plan.children().apply(k)) for k in range(plan.children().size()))


def _placed(df: DataFrame) -> DataFrame | None:
    """``df`` keyed by file and row in it, files in the order of their paths; None where the reader gives no row numbers."""
    spark, path, place = df.sparkSession, OWN + "path", OWN + "place"
    try:
        meta = df.metadataColumn("_metadata")
        rows = df.select("*", meta["file_path"].alias(path), meta["row_index"].alias(KEY))
    except AnalysisException:
        return None
    files = sorted(set(df.inputFiles()))
    if not files or len(files) >= 1 << 23:
        return None
    names = [(k, n) for k, f in enumerate(files) for n in {f, re.sub(r"^([^:/]+):///", r"\1:/", f)}]  # the reader may leave out an empty host
    order = spark.range(0, 1, 1, 1).select(F.explode(F.arrays_zip(F.lit([k for k, _ in names]).alias(place), F.lit([n for _, n in names]).alias(path))).alias("f")).select("f.*")
    known = F.coalesce(F.col(place).cast("long"), F.raise_error(F.concat(F.lit("a file that wasn't listed: "), F.col(path))).cast("long"))
    return rows.join(F.broadcast(order), path, "left").withColumn(KEY, F.shiftleft(known, 40) + F.col(KEY)).drop(path, place)


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with a row key, the same at each reading, however the scan is split; rows that aren't read straight from Parquet files are stored with it."""
    placed = _placed(df) if _only_reads(df._jdf.queryExecution().analyzed()) else None
    return written(df.withColumn(KEY, F.monotonically_increasing_id()), "rows") if placed is None else placed


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, the text (null as empty) and the row key, under internal names."""
    df = docs if KEY in docs.columns else keyed(docs)
    return df.select(F.col(f"`{id_col}`").cast("long").alias(OWN + "id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(OWN + "text"), KEY)


def chunks(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in a column each, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.Table]:
    """Consecutive rows of a partition in tables of about ``limit`` bytes in a column."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, column, limit):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs starts, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; an empty run has 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b), root the smallest node of its connected component.

    Alternates large-star and small-star steps. Each step is a grouped minimum, which is combined before the shuffle, and a
    join, which Spark can split where it is skewed, so no node's neighbours ever meet in one task. Null ends are dropped.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = None
    for _ in range(rounds):
        last = _made[-1]
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = written(small, f"{name}-edges")
        _delete(e.sparkSession, last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
