"""The telemetry views over the shared tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.timeutil import epoch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tel(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", epoch("ts").alias("t"), "user_id", F.col("event_type").alias("channel"), "value")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Labels: large errors. Their class is the user's last digit modulo 5."""
    return tel(spark, sf).where("channel = 'error' and value >= 120").select(F.col("event_id").alias("case_id"), "t", "user_id", (F.col("user_id") % 5).alias("class"))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).where("value > 100 and channel <> 'error'").select("t")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A regular grid of 600 s steps: t, score, n; empty steps are missing."""
    return tel(spark, sf).groupBy((F.floor(F.col("t") / 600) * 600).alias("t")).agg(F.avg("value").alias("score"), F.count("*").alias("n"))


def ten(spark: SparkSession, sf: str) -> DataFrame:
    """A feature tensor in long form: vec_id, label, dim, v, modality."""
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    kind = F.when(F.col("dim") < 44, "metric").when(F.col("dim") < 54, "trace").otherwise("log")
    return long.select("vec_id", "label", "dim", F.col("x").cast("double").alias("v"), kind.alias("modality"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Five seeds of ten logits per vector: dims 10 s to 10 s + 9."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed"))
    return e.select("vec_id", "label", "seed", F.slice("embedding", F.col("seed") * 10 + 1, F.lit(10)).cast("array<double>").alias("z"))


TEL = "tel AS (SELECT event_id, epoch_us(ts)//1000000 AS t, user_id, event_type AS channel, value FROM events)"
CASES = TEL + ", cs AS (SELECT event_id AS case_id, t, user_id, user_id % 5 AS class FROM tel WHERE channel='error' AND value >= 120)"
ALERTS = CASES + ", al AS (SELECT t, event_id FROM tel WHERE value > 100 AND channel <> 'error')"
GRID = ALERTS + ", grid AS (SELECT (t//600)*600 AS t, avg(value) AS score, count(*) AS n FROM tel GROUP BY 1)"
GROUPS = (
    ALERTS + ", g0 AS (SELECT t, event_id, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) >= 600 THEN 1 ELSE 0 END AS nw FROM al), g1 AS (SELECT t, sum(nw) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g0)"
    ", grp AS (SELECT min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM g1 GROUP BY i), iv AS (SELECT DISTINCT start_t, end_t FROM grp WHERE start_t < end_t)"
)
TEN = "ten AS (SELECT vec_id, label, (unnest(range(1, 65)) - 1)::INTEGER AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), tm AS (SELECT *, CASE WHEN dim < 44 THEN 'metric' WHEN dim < 54 THEN 'trace' ELSE 'log' END AS modality FROM ten)"
PROBS = TEN + (
    ", lg AS (SELECT vec_id, label, dim // 10 AS seed, dim % 10 AS k, v FROM ten WHERE dim < 50), ex AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id, seed)) AS e FROM lg)"
    ", pr AS (SELECT vec_id, label, seed, k, e / sum(e) OVER (PARTITION BY vec_id, seed) AS p FROM ex)"
    ", pred AS (SELECT vec_id, any_value(label) AS label, seed, min(k) FILTER (WHERE v = mx)::INTEGER AS pred FROM (SELECT *, max(v) OVER (PARTITION BY vec_id, seed) AS mx FROM lg) GROUP BY vec_id, seed)"
)
