"""The queries opN_<name> and their SQL: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, license_scan, media, mixing, quality, token_codes, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "set_class", "set_size")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the web pages themselves; op8's are of documents."""
    return media.page_sequences(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "again")
    order = [F.asc_nulls_last("position"), "doc_id"]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_token_codes, op3_license_scan, op4_quality, op5_bpe, op6_toxicity, op7_jaccard_join, op8_media, op9_warc, op10_mixing, interleaved_pages)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": DEDUP_SQL, "op7_jaccard_join": JACCARD_SQL, "op9_warc": WARC_SQL, "op10_mixing": mixing.SQL}


DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS chars FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

#: Every pair of sets that shares a shingle, counted: for small tables only.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingles FROM w
), k AS (
  SELECT doc_id, md5(array_to_string(shingles, '|')) AS k, shingles FROM s
), c AS (
  SELECT k, min(doc_id) AS set_class, count(*) AS set_size, any_value(shingles) AS shingles, len(any_value(shingles)) AS n FROM k GROUP BY k
), x AS MATERIALIZED (
  SELECT set_class, set_size, n, hash(unnest(shingles)) AS x FROM c
), l AS MATERIALIZED (
  SELECT a.set_class AS a, b.set_class AS b, any_value(a.set_size) AS na, any_value(b.set_size) AS nb FROM x a JOIN x b ON a.x = b.x AND a.set_class < b.set_class AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY 1, 2 HAVING 1000 * count(*) >= 800 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (
  SELECT a, b, nb AS n FROM l UNION ALL SELECT b, a, na FROM l
), r AS (
  SELECT set_class AS a, set_class AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), g AS (
  SELECT a AS set_class, min(b) AS class_id FROM r GROUP BY a
), t AS (
  SELECT a AS set_class, sum(n) AS n FROM e GROUP BY a
)
SELECT k.doc_id, g.class_id, (coalesce(t.n, 0) + c.set_size - 1)::BIGINT AS n_links, c.set_class, c.set_size FROM k JOIN c USING (k) JOIN g ON g.set_class = c.set_class LEFT JOIN t ON t.set_class = c.set_class
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT h, max(page_id) AS top, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h || '0', (i * 5 // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - i * 5 % 4)::INTEGER) % 32 + 1, 1)), '') AS payload_digest
  FROM p GROUP BY h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN d USING (h)
"""
