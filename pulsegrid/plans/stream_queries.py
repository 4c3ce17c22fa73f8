"""The replayed minute stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import scratch
from pulsegrid.streaming import minutes

from .registry import query
from .views import TEL, tel

RULE = minutes.Rule(threshold=30.0, step=3600, context=6, gap=3 * 3600, limit=120.0)

#: The same rows from windows over the whole table.
STREAM_SQL = "WITH " + TEL + f""", g AS (SELECT channel AS entity, (t // {RULE.step}) * {RULE.step} AS t, avg(value) AS value FROM tel GROUP BY ALL),
 s0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) = {RULE.step} THEN 0 ELSE 1 END AS nw FROM g), s AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM s0),
 k AS (SELECT *, row_number() OVER (PARTITION BY entity, seg ORDER BY t) AS k, avg(value) OVER (PARTITION BY entity, seg ORDER BY t ROWS BETWEEN {RULE.context} PRECEDING AND 1 PRECEDING) AS m FROM s),
 w AS (SELECT entity, seg, t, abs(value - m) AS score FROM k WHERE k > {RULE.context}), r AS (SELECT entity, t, score, greatest(score, coalesce(lag(score) OVER (PARTITION BY entity, seg ORDER BY t), score)) AS rolled FROM w),
 a AS (SELECT entity, t, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) >= {RULE.gap} THEN 1 ELSE 0 END AS nw FROM r WHERE rolled > {RULE.threshold}), b AS (SELECT entity, t, sum(nw) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM a),
 z AS (SELECT entity, max(t) AS top FROM r GROUP BY entity), i AS (SELECT b.entity, min(t) AS t, max(t) AS end_t FROM b GROUP BY b.entity, i HAVING min(t) < max(t)),
 q AS (SELECT i.*, top - end_t < {RULE.gap} AS open, top = end_t AS may FROM i JOIN z USING (entity))
 SELECT entity, 'window' AS kind, NULL AS code, t, NULL::BIGINT AS end_t, round(score, 6) AS score, round(rolled, 6) AS rolled, rolled > {RULE.threshold} AS alert, NULL::BOOLEAN AS may_continue FROM r
 UNION ALL SELECT entity, 'warning', 'out_of_range', t, NULL, round(value, 6), NULL, NULL, NULL FROM g WHERE abs(value) > {RULE.limit}
 UNION ALL SELECT entity, 'incident', CASE WHEN open THEN 'open' ELSE 'closed' END, t, end_t, NULL, NULL, NULL, open AND may FROM q"""


@query("stream_replay", STREAM_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means of each event type, replayed as a stream in slices of ten days; the result of a stream that has run to its end, incidents still open included."""
    t = F.floor(F.col("t") / RULE.step) * RULE.step
    grid = tel(spark, sf).groupBy(F.col("channel").alias("entity"), t.alias("t")).agg(F.avg("value").alias("value"))
    folder = scratch(spark, "replay")
    minutes.slices(grid, f"{folder}/in", "t", 10 * 86_400)
    out = minutes.run_to_end(minutes.minute_alerts(minutes.replay(spark, f"{folder}/in", "entity string, t long, value double"), RULE), folder)
    return out.withColumn("score", F.round("score", 6)).withColumn("rolled", F.round("rolled", 6))
