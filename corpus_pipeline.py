"""A corpus pipeline of five stages; each works on all documents that its predecessor kept.

In all stages a null text counts as an empty one, a text of any length is one document, and columns beside doc_id, text and source
may be null or absent; extra columns are carried along. Ids may be null or repeat: rows are told apart by a row key, never by id.
An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from pulsegrid.llm.common import KEY, keyed, released, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, all columns.

    Null and empty texts have the score of a text without words; rows that repeat a text have equal scores and go or stay together.
    Without enough labels every document has the score of their share, or 0.5, and stays.
    """
    rows = keyed(docs)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = toxicity.score_toxicity(rows, model).where("predicted = 1").select(KEY)
    return rows.join(rejected, KEY, "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, all columns: the longest original, then the smallest id (null last), then the first row.

    Null, empty and white texts are one group, of which one row stays.
    """
    rows = keyed(docs)
    kept = exact_dedup.exact_dedup(rows).where("kept").select(KEY)
    return rows.join(kept, KEY, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, all columns: that with the smallest id (null last), then the first row.

    Texts without words are one group; texts of fewer words than a shingle are alike only if their words are the same.
    """
    rows = keyed(docs)
    kept = jaccard_join.jaccard_join(rows).where("first").select(KEY)
    return rows.join(kept, KEY, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, in training order, all columns.

    A null source is a source of its own. Texts without words have size 0 and aren't taken. Uses at the same position are in the order
    of their row keys.
    """
    rows = keyed(docs)
    return mixing.mixed_order(rows, mixing.mix(rows, whole=True)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded bytes of each row: a use of a document in the mix is a row of its own.

    Null and empty texts have no tokens.
    """
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: Model, MinHash and BPE stages can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a stored table before the next stage reads it, and what a stage stored for itself is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with released(spark) as kept:
            docs = kept(written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
    return STAGES[-1][1](spark, docs, sf_dir)
