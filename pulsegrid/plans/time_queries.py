"""Queries on telemetry in time: intervals, scoring, windows, joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import maths
from pulsegrid.functions.timeutil import floor_to, iso, local_day, utc_date
from pulsegrid.operators import detection
from pulsegrid.operators import intervals as iv
from pulsegrid.operators.ordered import cumulative

from .registry import query
from .views import ALERTS, CASES, GRID, GROUPS, TEL, alerts, cases, grid, tel

IV = "WITH " + GROUPS


@query("alert_intervals", IV + " SELECT start_t, end_t FROM iv")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iv.alert_intervals(alerts(spark, sf))


@query("alert_singletons", IV + " SELECT count(*) AS n_groups, count(*) FILTER (WHERE start_t = end_t) AS n_dropped, max(n) AS largest FROM grp")
def _(spark, sf):
    g = iv.alert_groups(alerts(spark, sf))
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("start_t") == F.col("end_t")).alias("n_dropped"), F.max("n").alias("largest"))


EVENT_SQL = IV + (
    ", lb AS (SELECT DISTINCT t FROM cs), h AS (SELECT lb.t, iv.start_t FROM lb JOIN iv ON iv.start_t <= lb.t + 300 AND iv.end_t >= lb.t - 300)"
    ", c AS (SELECT (SELECT count(DISTINCT t) FROM h) AS tp, (SELECT count(*) FROM iv) - (SELECT count(DISTINCT start_t) FROM h) AS fp, (SELECT count(*) FROM lb) AS nl, (SELECT count(*) FROM iv) AS ni, (SELECT count(*) FROM h) AS pairs, (SELECT count(DISTINCT start_t) FROM h) AS hit)"
    ", s AS (SELECT *, ni > 0 AND nl > 0 AND tp + fp > 0 AND tp > 0 AS scored, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) ELSE 0.0 END AS pr, CASE WHEN nl > 0 THEN round_even(tp / nl, 4) ELSE 0.0 END AS re FROM c)"
    " SELECT ni AS n_intervals, nl AS n_labels, tp, fp, nl - tp AS fn, pr AS precision, re AS recall, CASE WHEN pr + re > 0 THEN round_even(2 * pr * re / (pr + re), 4) ELSE 0.0 END AS f1, CASE WHEN hit > 0 THEN round_even(pairs / hit, 2) ELSE 0.0 END AS density, scored FROM s"
)


@query("event_scoring", EVENT_SQL)
def event_scoring(spark, sf):
    """Precision counts intervals, recall counts labels; F1 is of the rounded two."""
    return detection.event_metrics(iv.alert_intervals(alerts(spark, sf)), cases(spark, sf).select("t"))


@query("label_matches", IV + ", lb AS (SELECT DISTINCT t FROM cs) SELECT lb.t, count(iv.start_t) AS n_intervals, min(iv.start_t) AS first_start FROM lb LEFT JOIN iv ON iv.start_t <= lb.t + 300 AND iv.end_t >= lb.t - 300 GROUP BY lb.t")
def _(spark, sf):
    labels = cases(spark, sf).select("t").distinct()
    hit = detection.hits(iv.alert_intervals(alerts(spark, sf)), labels)
    return labels.join(hit, "t", "left").groupBy("t").agg(F.count("start_t").alias("n_intervals"), F.min("start_t").alias("first_start"))


@query("interval_classes", IV + ", c AS (SELECT start_t, end_t, EXISTS (SELECT 1 FROM cs WHERE start_t <= cs.t + 300 AND end_t >= cs.t - 300) AS hit, EXISTS (SELECT 1 FROM cs WHERE start_t <= cs.t + 900 AND end_t >= cs.t - 900) AS near FROM iv) SELECT start_t, end_t, CASE WHEN hit THEN 'hit' WHEN near THEN 'ignore_overlap' ELSE 'normal_only' END AS kind FROM c")
def _(spark, sf):
    return detection.interval_classes(iv.alert_intervals(alerts(spark, sf)), cases(spark, sf).select("t"), 300, 900)


@query("detection_delay", IV + ", d AS (SELECT cs.case_id, min(iv.start_t) - min(cs.t) AS delay FROM cs JOIN iv ON iv.start_t <= cs.t + 300 AND iv.end_t >= cs.t - 300 GROUP BY cs.case_id) SELECT count(*) AS n, median(delay)::DOUBLE AS median_delay, round(avg(delay), 6) AS mean_delay, min(delay) AS min_delay, max(delay) AS max_delay, count(*) FILTER (WHERE delay < 0) AS n_negative FROM d")
def _(spark, sf):
    return detection.delay_summary(iv.alert_intervals(alerts(spark, sf)), cases(spark, sf).select("case_id", "t"))


@query("rolling_max", "WITH " + GRID + " SELECT t, round(score, 6) AS score, round(max(score) OVER (ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW), 6) AS rolled FROM grid")
def _(spark, sf):
    return iv.rolling_max(grid(spark, sf), "score", 600).select("t", F.round("score", 6).alias("score"), F.round("rolled", 6).alias("rolled"))


RUNS = "WITH " + GRID + ", r0 AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <> 600 THEN 1 ELSE 0 END AS nw FROM grid), r1 AS (SELECT t, sum(nw) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM r0), rn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS k, count(*) OVER (PARTITION BY i) AS len FROM r1)"


@query("sliding_windows", RUNS + ", w AS (SELECT t AS start, t + 3600 AS target FROM rn WHERE k <= len - 6) SELECT start, target, CASE WHEN target < 1704931200 THEN 'fit' WHEN start >= 1704931200 AND target < 1705536000 THEN 'calibration' WHEN start >= 1705536000 THEN 'test' ELSE 'crossing' END AS period FROM w")
def _(spark, sf):
    w = iv.windows(grid(spark, sf), 7, 600)
    a, b = 1704931200, 1705536000
    period = F.when(F.col("target") < a, "fit").when((F.col("start") >= a) & (F.col("target") < b), "calibration").when(F.col("start") >= b, "test").otherwise("crossing")
    return w.withColumn("period", period)


@query("window_capacity", RUNS + ", c AS (SELECT i, min(t) AS start_t, max(t) AS end_t, count(*) AS len FROM rn GROUP BY i) SELECT start_t, end_t, len, greatest(0, len - 6) AS capacity, len < 7 AS short FROM c")
def _(spark, sf):
    c = iv.island_spans(grid(spark, sf), lambda g: g != 600).withColumnRenamed("n", "len")
    return c.select("start_t", "end_t", "len", F.greatest(F.lit(0), F.col("len") - 6).alias("capacity"), (F.col("len") < 7).alias("short"))


@query("strided_windows", RUNS + " SELECT t AS start FROM rn WHERE k <= len - 6 AND (k - 1) % 5 = 0")
def _(spark, sf):
    return iv.strided(grid(spark, sf), 7, 600, 5)


@query("window_categories", RUNS + """, w AS (SELECT t AS start, t + 3600 AS target FROM rn WHERE k <= len - 6),
 m AS (SELECT w.start, max(cs.case_id) AS last_case, min(cs.class) <> max(cs.class) AS ambiguous FROM w JOIN cs ON w.target >= cs.t - 59 AND w.target < cs.t + 300 GROUP BY w.start),
 g AS (SELECT DISTINCT w.start FROM w JOIN cs ON w.target >= cs.t - 179 AND w.start < cs.t + 600)
 SELECT w.start, w.target, CASE WHEN m.start IS NOT NULL THEN 'event_associated' WHEN g.start IS NOT NULL THEN 'ignore' ELSE 'normal_reference' END AS category, coalesce(m.ambiguous, false) AS ambiguous,
 CASE WHEN NOT m.ambiguous THEN m.last_case END AS case_id FROM w LEFT JOIN m USING (start) LEFT JOIN g USING (start)""")
def _(spark, sf):
    return detection.window_categories(iv.windows(grid(spark, sf), 7, 600), cases(spark, sf), match=(59, 300), guard=(179, 600))


SEG = "WITH " + TEL + ", d AS (SELECT t, t - lag(t) OVER (ORDER BY t, event_id) AS step FROM tel)"


@query("segments", SEG + ", s AS (SELECT t, sum(CASE WHEN step > 600 THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT DISTINCT ON (t) t, step FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM (SELECT DISTINCT t FROM tel)))) SELECT min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM s GROUP BY i")
def _(spark, sf):
    return iv.island_spans(tel(spark, sf).select("t").distinct(), lambda g: g > 600)


@query("collection_days", SEG + ", u AS (SELECT DISTINCT t FROM tel), q AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM u), s AS (SELECT t, sum(CASE WHEN step > 1500 THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM q) SELECT min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM s GROUP BY i")
def _(spark, sf):
    return iv.island_spans(tel(spark, sf).select("t").distinct(), lambda g: g > 1500)


@query("sampling_profile", SEG + " SELECT count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(*) - count(DISTINCT t) AS duplicates, count(*) FILTER (WHERE step >= 600) AS gaps, max(step) AS max_step, median(step)::DOUBLE AS median_step FROM d")
def _(spark, sf):
    d = iv.with_previous(tel(spark, sf), "t", ("t", "event_id")).withColumn("step", F.col("t") - F.col("prev"))
    return d.agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.count("*") - F.count_distinct("t")).alias("duplicates"), F.count_if(F.col("step") >= 600).alias("gaps"), F.max("step").alias("max_step"), F.percentile("step", F.lit(0.5)).alias("median_step"))


@query("step_histogram", SEG + " SELECT step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY step ORDER BY n DESC, step LIMIT 10")
def _(spark, sf):
    d = iv.with_previous(tel(spark, sf), "t", ("t", "event_id")).select((F.col("t") - F.col("prev")).alias("step")).where("step is not null")
    return d.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step").limit(10)


@query("segment_median", RUNS + ", c AS (SELECT count(*) AS len FROM rn GROUP BY i), o AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS k, count(*) OVER () AS m FROM c) SELECT m AS n_segments, len AS upper_median FROM o WHERE k = m // 2")
def _(spark, sf):
    c = iv.island_spans(grid(spark, sf), lambda g: g != 600)
    by = cumulative(c.groupBy(F.col("n").alias("len")).agg(F.count("*").alias("k")), "len", ["k"])  # the upper middle element, from counts by length
    return by.where("before_k + k > all_k div 2").groupBy(F.col("all_k").alias("n_segments")).agg(F.min("len").alias("upper_median"))


@query("nearest_tolerance", "WITH " + ALERTS + ", j AS (SELECT cs.case_id, al.t AS near, abs(cs.t - al.t) AS d FROM cs JOIN al ON abs(cs.t - al.t) <= 900), b AS (SELECT case_id, min(d) AS distance FROM j GROUP BY case_id), e AS (SELECT j.case_id, min(j.near) AS near, b.distance FROM j JOIN b ON j.case_id = b.case_id AND j.d = b.distance GROUP BY j.case_id, b.distance) SELECT cs.case_id, cs.t, e.near, e.distance FROM cs LEFT JOIN e USING (case_id)")
def _(spark, sf):
    left = cases(spark, sf).select("case_id", "t", F.col("case_id").alias("_id"))
    return iv.nearest(left, alerts(spark, sf).withColumnRenamed("t", "at"), "t", "at", 900).select("case_id", "t", "near", "distance")


@query("nearest_case", "WITH " + ALERTS + ", c AS (SELECT DISTINCT t FROM cs), a AS (SELECT DISTINCT t FROM al), j AS (SELECT a.t, (SELECT max(c.t) FROM c WHERE c.t <= a.t) AS b, (SELECT min(c.t) FROM c WHERE c.t >= a.t) AS f FROM a) SELECT t, CASE WHEN f IS NULL OR t - b <= f - t THEN b ELSE f END AS near, abs(t - CASE WHEN f IS NULL OR t - b <= f - t THEN b ELSE f END) AS distance FROM j")
def _(spark, sf):
    left = alerts(spark, sf).distinct().withColumn("_id", F.col("t"))
    return iv.nearest_any(left, cases(spark, sf).select(F.col("t").alias("ct")).distinct(), "t", "ct").select("t", "near", "distance")


@query("window_counts", "WITH " + CASES + " SELECT cs.case_id, count(tel.t) AS n FROM cs LEFT JOIN tel ON tel.t >= cs.t - 59 AND tel.t < cs.t + 300 GROUP BY cs.case_id")
def _(spark, sf):
    spans = cases(spark, sf).select("case_id", (F.col("t") - 59).alias("lo"), (F.col("t") + 299).alias("hi"))
    n = iv.bucket_join(tel(spark, sf).select("t"), spans, "t", "lo", "hi", 300).groupBy("case_id").agg(F.count("*").alias("k"))
    return cases(spark, sf).select("case_id").join(n, "case_id", "left").select("case_id", F.coalesce("k", F.lit(0)).alias("n"))


@query("near_event_semi", "WITH " + CASES + " SELECT event_id, t FROM tel WHERE channel = 'purchase' AND EXISTS (SELECT 1 FROM cs WHERE abs(cs.t - tel.t) <= 120)")
def _(spark, sf):
    spans = cases(spark, sf).select((F.col("t") - 120).alias("lo"), (F.col("t") + 120).alias("hi")).distinct()
    return iv.bucket_join(tel(spark, sf).where("channel = 'purchase'").select("event_id", "t"), spans, "t", "lo", "hi", 240, "left_semi")


@query("point_in_segment", RUNS + ", s AS (SELECT i, min(t) AS lo, max(t) + 599 AS hi FROM rn GROUP BY i) SELECT cs.case_id, s.lo AS segment_start, cs.t - s.lo AS off FROM cs LEFT JOIN s ON cs.t BETWEEN s.lo AND s.hi")
def _(spark, sf):
    seg = iv.island_spans(grid(spark, sf), lambda g: g != 600).select(F.col("start_t").alias("lo"), (F.col("end_t") + 599).alias("hi"))
    c = cases(spark, sf).select("case_id", "t")
    return iv.bucket_join(c, seg, "t", "lo", "hi", 86_400, "left").select("case_id", F.col("lo").alias("segment_start"), (F.col("t") - F.col("lo")).alias("off"))


@query("incident_groups", "WITH " + CASES + ", x AS (SELECT t - 900 AS lo, t + 900 AS hi FROM cs), o AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x), n AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT min(lo) AS start_t, max(hi) AS end_t, count(*) AS n FROM n GROUP BY i")
def _(spark, sf):
    return iv.episodes(cases(spark, sf).select((F.col("t") - 900).alias("lo"), (F.col("t") + 900).alias("hi")), "lo", "hi")


@query("episode_merge", IV + ", x AS (SELECT start_t AS lo, end_t + 900 AS hi FROM iv), o AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x), n AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT min(lo) AS start_t, max(hi) AS end_t, count(*) AS n FROM n GROUP BY i")
def _(spark, sf):
    return iv.episodes(iv.alert_intervals(alerts(spark, sf)).select(F.col("start_t").alias("lo"), (F.col("end_t") + 900).alias("hi")), "lo", "hi")


@query("boundary_scan", "WITH " + CASES + ", o AS (SELECT t, class, row_number() OVER (ORDER BY t, case_id) AS k, t - lag(t) OVER (ORDER BY t, case_id) AS gap, sum(CASE WHEN class = 0 THEN 1 ELSE 0 END) OVER (ORDER BY t, case_id ROWS UNBOUNDED PRECEDING) AS zeros FROM cs) SELECT k, t, gap, (zeros - CASE WHEN class = 0 THEN 1 ELSE 0 END)::BIGINT AS zeros_before, gap >= 3600 AS safe, t - gap // 2 AS boundary FROM o WHERE gap IS NOT NULL")
def _(spark, sf):
    c = cases(spark, sf)
    c = iv.with_previous(c, "t", ("t", "case_id"))
    c = iv.with_running(c, F.lit(1), ("t", "case_id"), "k")
    c = iv.with_running(c, (F.col("class") == 0).cast("long"), ("t", "case_id"), "zeros")
    gap = F.col("t") - F.col("prev")
    return c.where("prev is not null").select(F.col("k").cast("long").alias("k"), "t", gap.alias("gap"), (F.col("zeros") - (F.col("class") == 0).cast("long")).alias("zeros_before"), (gap >= 3600).alias("safe"), (F.col("t") - F.floor(gap / 2)).alias("boundary"))


@query("rolling_origin", "WITH " + CASES + ", o AS (SELECT t, row_number() OVER (ORDER BY t, case_id) AS k, t - lag(t) OVER (ORDER BY t, case_id) AS gap, count(*) OVER () AS n FROM cs), f AS (SELECT unnest([40, 60, 80]) AS fold) SELECT f.fold, min(o.k) AS k FROM f LEFT JOIN o ON o.gap >= 3600 AND o.k * 100 >= f.fold * o.n GROUP BY f.fold")
def _(spark, sf):
    c = iv.with_running(iv.with_previous(cases(spark, sf), "t", ("t", "case_id")), F.lit(1), ("t", "case_id"), "k")
    c = c.crossJoin(cases(spark, sf).agg(F.count("*").alias("n"))).where("t - prev >= 3600").select("k", "n")
    folds = spark.createDataFrame([(40,), (60,), (80,)], "fold int")
    return folds.join(c, F.col("k") * 100 >= F.col("fold") * F.col("n"), "left").groupBy("fold").agg(F.min("k").cast("long").alias("k"))


@query("label_reconciliation", "WITH " + CASES + ", a AS (SELECT DISTINCT t FROM cs), b AS (SELECT DISTINCT t FROM tel WHERE channel = 'error' AND value >= 115 AND value < 180), j AS (SELECT coalesce(a.t, b.t) AS t, a.t AS x, b.t AS y FROM a FULL JOIN b ON a.t = b.t) SELECT t, CASE WHEN x IS NULL THEN 'ad_only' WHEN y IS NULL THEN 'case_only' ELSE 'shared' END AS side FROM j")
def _(spark, sf):
    a = cases(spark, sf).select(F.col("t").alias("x")).distinct()
    b = tel(spark, sf).where("channel = 'error' and value >= 115 and value < 180").select(F.col("t").alias("y")).distinct()
    side = F.when(F.col("x").isNull(), "ad_only").when(F.col("y").isNull(), "case_only").otherwise("shared")
    return a.join(b, F.col("x") == F.col("y"), "full_outer").select(F.coalesce("x", "y").alias("t"), side.alias("side"))


@query("offset_alignment", "WITH " + GRID + ", o AS (SELECT cs.case_id, cs.class, k, (cs.t//600)*600 + 600 * k AS at FROM cs, unnest(range(-9, 5)) u(k)) SELECT o.class, o.k, count(*) AS n, round(avg(grid.score), 3) AS mean_score FROM o JOIN grid ON grid.t = o.at GROUP BY o.class, o.k")
def _(spark, sf):
    o = cases(spark, sf).select("class", floor_to(F.col("t"), 600).alias("t0"), F.explode(F.sequence(F.lit(-9), F.lit(4))).alias("k"))
    o = o.select("class", F.col("k").cast("long").alias("k"), (F.col("t0") + 600 * F.col("k")).alias("t"))
    return o.join(grid(spark, sf), "t").groupBy("class", "k").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"))


@query("pre_post_ratio", "WITH " + GRID + ", o AS (SELECT cs.class, k, (cs.t//600)*600 + 600 * k AS at FROM cs, unnest(range(-6, 6)) u(k)) SELECT o.class, round(avg(CASE WHEN k < 0 THEN score END), 6) AS pre, round(avg(CASE WHEN k >= 0 THEN score END), 6) AS post, round(avg(CASE WHEN k >= 0 THEN score END) / avg(CASE WHEN k < 0 THEN score END), 6) AS ratio FROM o JOIN grid ON grid.t = o.at GROUP BY o.class")
def _(spark, sf):
    o = cases(spark, sf).select("class", floor_to(F.col("t"), 600).alias("t0"), F.explode(F.sequence(F.lit(-6), F.lit(5))).alias("k")).select("class", "k", (F.col("t0") + 600 * F.col("k")).alias("t"))
    pre, post = F.avg(F.when(F.col("k") < 0, F.col("score"))), F.avg(F.when(F.col("k") >= 0, F.col("score")))
    return o.join(grid(spark, sf), "t").groupBy("class").agg(F.round(pre, 6).alias("pre"), F.round(post, 6).alias("post"), F.round(F.try_divide(post, pre), 6).alias("ratio"))


CARRY = "WITH v AS (SELECT conv_id, turn, role, CASE WHEN role <> 'user' AND length(text) > 0 THEN turn END AS full_turn FROM conversations)"


@query("prev_next_complete", CARRY + " SELECT conv_id, turn, last_value(full_turn IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_turn, first_value(full_turn IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_turn FROM v")
def _(spark, sf):
    from pyspark.sql import Window as W

    from .views import table

    c = table(spark, sf, "conversations").withColumn("full_turn", F.when((F.col("role") != "user") & (F.length("text") > 0), F.col("turn")))
    w = W.partitionBy("conv_id").orderBy("turn")
    back, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    return c.select("conv_id", "turn", F.last("full_turn", True).over(back).alias("prev_turn"), F.first("full_turn", True).over(ahead).alias("next_turn"))


@query("time_formats", "WITH " + TEL + " SELECT event_id, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, (DATE '1970-01-01' + (t // 86400)::INTEGER) AS day, (DATE '1970-01-01' + ((t + 28800) // 86400)::INTEGER) AS local_day, t - t % 60 AS minute FROM tel")
def _(spark, sf):
    t = F.col("t")
    return tel(spark, sf).select("event_id", iso(t).alias("iso"), utc_date(t).alias("day"), local_day(t).alias("local_day"), floor_to(t).alias("minute"))


@query("temporal_trend_blocks", "WITH " + GRID + ", r AS (SELECT t, score, row_number() OVER (ORDER BY t) - 1 AS k FROM grid), b AS (SELECT k // 10 AS block, min(t) AS start_t, max(t) AS end_t, count(*) AS n, avg(score) AS m FROM r GROUP BY 1) SELECT block, start_t, round(m, 6) AS mean_score FROM b WHERE n = 10 AND end_t - start_t = 5400")
def _(spark, sf):
    r = iv.with_running(grid(spark, sf), F.lit(1), ("t",), "k").withColumn("block", F.floor((F.col("k") - 1) / 10))
    b = r.groupBy("block").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), F.avg("score").alias("m"))
    return b.where("n = 10 and end_t - start_t = 5400").select("block", "start_t", F.round("m", 6).alias("mean_score"))


@query("lag1_autocorr", "WITH " + GRID + ", p AS (SELECT score AS y, lag(score) OVER (ORDER BY t) AS x, t - lag(t) OVER (ORDER BY t) AS gap FROM grid) SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM p WHERE gap = 600")
def _(spark, sf):
    g = grid(spark, sf).select("t", "score")
    p = g.join(g.select((F.col("t") + 600).alias("t"), F.col("score").alias("x")), "t")
    r = F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("score") > 0), F.corr("x", "score"))
    return p.agg(F.count("*").alias("n"), F.round(r, 6).alias("r"))


@query("autocorrelation", "WITH " + GRID + ", k AS (SELECT unnest(range(1, 8)) AS lag) SELECT k.lag, count(*) AS n, round(corr(a.score, b.score), 6) AS r FROM k, grid a JOIN grid b ON b.t = a.t + 600 * k.lag GROUP BY k.lag")
def _(spark, sf):
    g = grid(spark, sf).select("t", "score")
    later = g.select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), "t", "score").select(F.col("k").cast("long").alias("lag"), (F.col("t") - 600 * F.col("k")).alias("t"), F.col("score").alias("y"))
    return g.join(later, "t").groupBy("lag").agg(F.count("*").alias("n"), F.round(F.corr("score", "y"), 6).alias("r"))


@query("threshold_search", "WITH " + GRID + ", y AS (SELECT grid.t, grid.score, EXISTS (SELECT 1 FROM cs WHERE cs.t // 600 = grid.t // 600) AS pos FROM grid), q AS (SELECT unnest(quantile_cont(score, [" + ", ".join(str(k / 500) for k in range(501)) + "])) AS tau FROM y WHERE NOT pos), c AS (SELECT DISTINCT tau FROM q), n AS (SELECT c.tau, avg(CASE WHEN y.score > c.tau THEN 1.0 ELSE 0.0 END) AS fpr FROM c, y WHERE NOT y.pos GROUP BY c.tau) SELECT round(min(tau), 6) AS tau FROM n WHERE fpr <= 0.05")
def _(spark, sf):
    return detection.threshold_search(detection.labelled_grid(grid(spark, sf), cases(spark, sf)), 500, 0.05).select(F.round("tau", 6).alias("tau"))


@query("threshold_metrics", "WITH " + GRID + ", y AS (SELECT grid.t, grid.score, EXISTS (SELECT 1 FROM cs WHERE cs.t // 600 = grid.t // 600) AS pos FROM grid), c AS (SELECT unnest([50.0, 52.0, 54.0, 56.0, 60.0]) AS tau), k AS (SELECT tau, count(*) FILTER (WHERE pos AND score > tau) AS tp, count(*) FILTER (WHERE NOT pos AND score > tau) AS fp, count(*) FILTER (WHERE pos AND score <= tau) AS fn, count(*) FILTER (WHERE NOT pos AND score <= tau) AS tn FROM c, y GROUP BY tau) SELECT tau::DOUBLE AS tau, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0.0 END AS fpr FROM k")
def _(spark, sf):
    taus = spark.createDataFrame([(x,) for x in (50.0, 52.0, 54.0, 56.0, 60.0)], "tau double")
    c = detection.confusion_at(detection.labelled_grid(grid(spark, sf), cases(spark, sf)), taus)
    r = lambda a, b, n: F.round(maths.div0(F.col(a), F.col(a) + F.col(b)), 6).alias(n)
    return c.select("tau", "tp", "fp", "fn", "tn", r("tp", "fp", "precision"), r("tp", "fn", "recall"), r("fp", "tn", "fpr"))


@query("first_detection", "WITH " + CASES + " SELECT cs.case_id, min(tel.t) AS first_t, min(tel.t) - min(cs.t) AS delay FROM cs LEFT JOIN tel ON tel.user_id = cs.user_id AND tel.t > cs.t AND tel.t <= cs.t + 86400 AND tel.value > 100 GROUP BY cs.case_id")
def _(spark, sf):
    e = tel(spark, sf).where("value > 100").select(F.col("user_id").alias("u"), F.col("t").alias("at"), F.floor(F.col("t") / 86400).alias("d"))
    day = lambda x: F.floor((F.col("t") + x) / 86400)
    c = cases(spark, sf).select("case_id", "user_id", "t", F.explode(F.array_distinct(F.array(day(1), day(86400)))).alias("day"))
    j = c.join(e, (F.col("u") == F.col("user_id")) & (F.col("d") == F.col("day")) & (F.col("at") > F.col("t")) & (F.col("at") <= F.col("t") + 86400), "left")
    return j.groupBy("case_id").agg(F.min("at").alias("first_t"), (F.min("at") - F.min("t")).alias("delay"))


@query("per_case_metrics", "WITH " + TEL + " SELECT user_id, count(*) FILTER (WHERE channel <> 'error') AS n_normal, round(avg(CASE WHEN channel <> 'error' THEN CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END END), 6) AS fpr, round(avg(CASE WHEN channel = 'error' THEN CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END END), 6) AS recall, min(CASE WHEN channel = 'error' AND value > 90 THEN t END) AS first_hit, round(max(CASE WHEN channel = 'error' THEN value END), 6) AS max_post FROM tel GROUP BY user_id")
def _(spark, sf):
    bad, over = F.col("channel") == "error", (F.col("value") > 90).cast("double")
    return tel(spark, sf).groupBy("user_id").agg(F.count_if(~bad).alias("n_normal"), F.round(F.avg(F.when(~bad, over)), 6).alias("fpr"), F.round(F.avg(F.when(bad, over)), 6).alias("recall"), F.min(F.when(bad & (F.col("value") > 90), F.col("t"))).alias("first_hit"), F.round(F.max(F.when(bad, F.col("value"))), 6).alias("max_post"))


@query("case_features", "WITH " + CASES + " SELECT cs.case_id, tel.channel, count(DISTINCT tel.t // 60) AS minutes, min(tel.t) AS first_t, max(tel.t) AS last_t, round(avg(tel.value), 6) AS mean_v, round(stddev_pop(tel.value), 6) AS sd_v, round(max(abs(tel.value)), 6) AS max_abs FROM cs JOIN tel ON tel.t >= cs.t - 1800 AND tel.t <= cs.t + 1800 GROUP BY cs.case_id, tel.channel")
def _(spark, sf):
    spans = cases(spark, sf).select("case_id", (F.col("t") - 1800).alias("lo"), (F.col("t") + 1800).alias("hi"))
    j = iv.bucket_join(tel(spark, sf).select("t", "channel", "value"), spans, "t", "lo", "hi", 3600)
    return j.groupBy("case_id", "channel").agg(F.count_distinct(F.floor(F.col("t") / 60)).alias("minutes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.avg("value"), 6).alias("mean_v"), F.round(F.stddev_pop("value"), 6).alias("sd_v"), F.round(F.max(F.abs("value")), 6).alias("max_abs"))


@query("alert_coverage", IV + ", p AS (SELECT DISTINCT t FROM al) SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM iv WHERE p.t BETWEEN iv.start_t - 60 AND iv.end_t + 60)) AS inside FROM p")
def _(spark, sf):
    p, spans = alerts(spark, sf).distinct(), iv.alert_intervals(alerts(spark, sf)).select((F.col("start_t") - 60).alias("lo"), (F.col("end_t") + 60).alias("hi"))
    inside = iv.bucket_join(p, spans, "t", "lo", "hi", 3600, "left_semi").agg(F.count("*").alias("inside"))
    return p.agg(F.count("*").alias("n")).crossJoin(inside)


@query("incident_agreement", IV + " SELECT iv.start_t, iv.end_t, count(DISTINCT cs.class) AS n_classes, string_agg(DISTINCT cs.class::VARCHAR, ',' ORDER BY cs.class::VARCHAR) AS classes FROM iv JOIN cs ON iv.start_t <= cs.t + 300 AND iv.end_t >= cs.t - 300 GROUP BY iv.start_t, iv.end_t")
def _(spark, sf):
    hit = detection.hits(iv.alert_intervals(alerts(spark, sf)), cases(spark, sf).select("t", "class"))
    return hit.groupBy("start_t", "end_t").agg(F.count_distinct("class").alias("n_classes"), F.array_join(F.array_sort(F.collect_set(F.col("class").cast("string"))), ",").alias("classes"))


@query("replay_segments", "WITH " + GRID + ", r AS (SELECT t, row_number() OVER (ORDER BY t) AS rn FROM grid) SELECT (rn - 7) // 60 AS segment, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM r WHERE rn >= 7 GROUP BY 1")
def _(spark, sf):
    r = iv.with_running(grid(spark, sf), F.lit(1), ("t",), "rn").where("rn >= 7")
    return r.groupBy(F.floor((F.col("rn") - 7) / 60).alias("segment")).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))
