"""White-space tokens of texts in Arrow, hashing, and the bounded labelled samples that the classifiers fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import starts_of

#: Bytes of text that a fitted sample has at most, so that the memory of what fits it is bounded; a sample keeps one text at least.
SAMPLE_BYTES = 64 << 20

GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct white-space tokens of some texts, each token's place among them, and where each text's tokens start."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    flat = split.flatten()
    bounds = starts_of(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        bounds = starts_of(full.astype(np.int64))[bounds]
        flat = flat.filter(pa.array(full))
    found = flat.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), bounds


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their high bits can be used as a hash."""
    values = (values ^ (values >> np.uint64(32))) * GOLD
    return values ^ (values >> np.uint64(29))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of a doc_id as text has this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def sampled(docs: DataFrame, labels: DataFrame, label: str, bound: int, skip: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """At most ``bound`` labelled (id, t, y) rows of ``SAMPLE_BYTES`` together, None without labels: those with the smallest hashes of their ids; held-out and unlabelled rows never.

    An id that has several labels counts once, with its largest. The ids, at most ``bound`` of them, are broadcast to the documents;
    of documents that repeat an id only the first text in order counts, so the bound holds.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"), skip.alias("skip")).where("not skip and y is not null and id is not null")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    spark = docs.sparkSession
    rows = spark.createDataFrame(chosen.toPandas(), "id long, y int") if chosen.head(1) else None
    if rows is None:
        return None
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).join(F.broadcast(rows), "id")
    ahead = W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0)  # at most ``bound`` rows
    found = texts.groupBy("id", "y").agg(F.min("t").alias("t")).withColumn("upto", F.sum(F.octet_length("t").cast("long")).over(ahead)).withColumn("place", F.row_number().over(W.orderBy(F.xxhash64("id"), "id")))
    return found.where((F.col("upto") <= SAMPLE_BYTES) | (F.col("place") == 1)).select("id", "t", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, skip: Column, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of the rows of ``sampled`` in the order of their ids."""
    found = sampled(docs, labels, label, bound, skip, id_col, text_col)
    return [] if found is None else [(r.t, r.y) for r in found.orderBy("id").select("t", "y").collect()]
