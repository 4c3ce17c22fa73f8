"""Queries on series, thresholds, masks and batches that the other modules' queries leave out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import maths, models, networks
from pulsegrid.operators import checks, detection, diagnostics, intervals, profile
from pulsegrid.operators import warehouse as wh

from .check_queries import BOUNDARY
from .registry import query, sql_of
from .views import CASES, GRID, TEL, TEN, cases, grid, table, tel, ten

T = "WITH " + TEN
R6 = lambda c: F.round(c, 6)


@query("percentile_ranks", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT unnest([95.0, 97.0, 99.0, 99.5])::DOUBLE AS p), h AS (SELECT *, (n - 1) * p / 100 AS h FROM c, p) SELECT event_type, p, n, round(h, 6) AS position, floor(h)::BIGINT + 1 AS lower_rank, ceil(h)::BIGINT + 1 AS upper_rank, n - floor(h)::BIGINT AS lower_from_top, n - ceil(h)::BIGINT AS upper_from_top, round(h - floor(h), 6) AS weight_on_upper FROM h")
def _(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.explode(F.array(*map(F.lit, (95.0, 97.0, 99.0, 99.5)))))
    r = c.select("event_type", "p", "n", *diagnostics.percentile_rank(F.col("n"), F.col("p")))
    return r.withColumn("position", R6("position")).withColumn("weight_on_upper", R6("weight_on_upper"))


@query("effective_sample_size", "WITH " + GRID + ", x AS (SELECT row_number() OVER (ORDER BY t) AS i, score - avg(score) OVER () AS x, count(*) OVER () AS n FROM grid), d AS (SELECT sum(x * x) AS d, max(n) AS n FROM x), r AS (SELECT b.i - a.i AS lag, sum(a.x * b.x) / max(d.d) AS rho FROM d, x a JOIN x b ON b.i > a.i AND b.i - a.i <= a.n // 4 GROUP BY 1), f AS (SELECT coalesce(min(lag) FILTER (WHERE rho <= 0), max(lag) + 1) AS first FROM r) SELECT d.n, f.first - 1 AS lags, round(d.n / (1 + 2 * coalesce((SELECT sum(rho) FROM r WHERE lag < f.first), 0)), 4) AS ess FROM d, f")
def _(spark, sf):
    return diagnostics.effective_sample_size(grid(spark, sf), "t", "score").withColumn("ess", F.round("ess", 4))


HOURS = "h AS (SELECT channel, t // 3600 AS h, avg(value) AS v FROM tel GROUP BY ALL)"


@query("lag1_by_channel", "WITH " + TEL + ", " + HOURS + ", r AS (SELECT a.channel, count(*) AS n, corr(a.v, b.v) AS r FROM h a JOIN h b ON a.channel = b.channel AND b.h = a.h + 1 GROUP BY a.channel) SELECT count(*) AS n_channels, sum(n)::BIGINT AS n_pairs, round(quantile_cont(r, 0.5), 6) AS median_r, round(quantile_cont(r, 0.1), 6) AS p10_r FROM r")
def _(spark, sf):
    """Autocorrelation at one step inside contiguous runs of each channel; median and tenth percentile over the channels that vary."""
    h = tel(spark, sf).groupBy("channel", F.floor(F.col("t") / 3600).alias("h")).agg(F.avg("value").alias("v"))
    j = h.join(h.select("channel", (F.col("h") - 1).alias("h"), F.col("v").alias("next")), ["channel", "h"])
    r = j.groupBy("channel").agg(F.count("*").alias("n"), F.when((F.stddev_pop("v") > 0) & (F.stddev_pop("next") > 0), F.corr("v", "next")).alias("r"))
    q = F.percentile("r", F.array(F.lit(0.5), F.lit(0.1)))
    return r.agg(F.count("r").alias("n_channels"), F.sum("n").alias("n_pairs"), R6(q[0]).alias("median_r"), R6(q[1]).alias("p10_r"))


@query("live_node_mean", "WITH " + TEL + ", c AS (SELECT t // 3600 AS hour, user_id, channel, avg(value) AS v FROM tel GROUP BY ALL), l AS (SELECT user_id, channel FROM tel GROUP BY ALL HAVING max(value) > 60) SELECT hour, c.channel, count(l.user_id) AS n_live, round(coalesce(sum(v) FILTER (WHERE l.user_id IS NOT NULL), 0) / greatest(count(l.user_id), 1), 6) AS mean FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.channel = c.channel GROUP BY hour, c.channel")
def _(spark, sf):
    """Mean over the live nodes of each hour and channel; a node is live in a channel where it ever exceeds the floor."""
    x = tel(spark, sf)
    c = x.groupBy(F.floor(F.col("t") / 3600).alias("hour"), "user_id", "channel").agg(F.avg("value").alias("v"))
    live = x.groupBy("user_id", "channel").agg(F.max("value").alias("m")).where("m > 60").select("user_id", "channel", F.lit(1).alias("on"))
    j = c.join(live, ["user_id", "channel"], "left")
    return j.groupBy("hour", "channel").agg(F.count("on").alias("n_live"), R6(F.coalesce(F.sum(F.when(F.col("on") == 1, F.col("v"))), F.lit(0.0)) / F.greatest(F.count("on"), F.lit(1))).alias("mean"))


@query("root_alignment", "WITH " + CASES + ", u AS (SELECT t // 3600 AS h, user_id, sum(abs(value)) AS s, count(*) AS n FROM tel GROUP BY ALL), a AS (SELECT h, sum(s) AS s, sum(n) AS n FROM u GROUP BY h), o AS (SELECT case_id, class, user_id, t // 3600 + k AS h, k FROM cs, unnest(range(-3, 4)) x(k)), j AS (SELECT o.class, o.k, u.s / u.n AS root, (a.s - coalesce(u.s, 0)) / nullif(a.n - coalesce(u.n, 0), 0) AS other FROM o JOIN a ON a.h = o.h LEFT JOIN u ON u.h = o.h AND u.user_id = o.user_id) SELECT class, k, count(root) AS n_root, round(avg(root), 5) AS root, count(other) AS n_other, round(avg(other), 5) AS other FROM j GROUP BY class, k")
def _(spark, sf):
    """Mean magnitude of a case's own node and of all others, hour by hour around the case, then the mean over the cases of a class."""
    u = tel(spark, sf).groupBy(F.floor(F.col("t") / 3600).alias("h"), "user_id").agg(F.sum(F.abs("value")).alias("s"), F.count("*").alias("n"))
    a = u.groupBy("h").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    o = cases(spark, sf).select("class", "user_id", F.floor(F.col("t") / 3600).alias("h0"), F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("k"))
    j = o.withColumn("h", F.col("h0") + F.col("k")).join(a, "h").join(u, ["h", "user_id"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    other = F.try_divide(F.col("all_s") - none("s"), F.col("all_n") - none("n"))
    return j.select("class", "k", (F.col("s") / F.col("n")).alias("r"), other.alias("o")).groupBy("class", "k").agg(F.count("r").alias("n_root"), F.round(F.avg("r"), 5).alias("root"), F.count("o").alias("n_other"), F.round(F.avg("o"), 5).alias("other"))


@query("case_vectors", "WITH " + CASES + ", m AS (SELECT cs.case_id, tel.channel, tel.t // 60 AS m, avg(value) AS v, max(abs(value)) AS p FROM cs JOIN tel ON tel.t BETWEEN cs.t - 1800 AND cs.t + 1800 GROUP BY ALL) SELECT case_id, channel, count(*) AS minutes, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(p), 6) AS max_abs, round(arg_max(v, m) - arg_min(v, m), 6) AS delta FROM m GROUP BY case_id, channel")
def _(spark, sf):
    spans = cases(spark, sf).select("case_id", (F.col("t") - 1800).alias("lo"), (F.col("t") + 1800).alias("hi"))
    j = intervals.bucket_join(tel(spark, sf).select("t", "channel", "value"), spans, "t", "lo", "hi", 3600)
    return diagnostics.case_vectors(j, ["case_id", "channel"], "t", "value").select("case_id", "channel", "minutes", *(R6(c).alias(c) for c in ("mean", "sd", "max_abs", "delta")))


TAUS = (50.0, 52.0, 54.0, 56.0, 60.0)


@query("threshold_candidates", "WITH " + GRID + ", y AS (SELECT grid.t, grid.score, EXISTS (SELECT 1 FROM cs WHERE cs.t // 600 = grid.t // 600) AS pos FROM grid), c AS (SELECT unnest([50.0, 52.0, 54.0, 56.0, 60.0])::DOUBLE AS tau), k AS (SELECT tau, count(*) FILTER (WHERE pos AND score > tau) AS tp, count(*) FILTER (WHERE NOT pos AND score > tau) AS fp, count(*) FILTER (WHERE pos AND score <= tau) AS fn, count(*) FILTER (WHERE NOT pos AND score <= tau) AS tn FROM c, y GROUP BY tau), d AS (SELECT c.tau, cs.case_id, min(grid.t) - min(cs.t) AS delay FROM c, cs JOIN grid ON grid.t > cs.t AND grid.t <= cs.t + 21600 WHERE grid.score > c.tau GROUP BY ALL), m AS (SELECT tau, count(*) AS detected, median(delay)::DOUBLE AS median_delay FROM d GROUP BY tau), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS f FROM k) SELECT r.tau, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(f, 6) AS fpr, coalesce(m.detected, 0) AS detected, m.median_delay FROM r LEFT JOIN m USING (tau)")
def _(spark, sf):
    """Precision, recall, F1, false-positive rate and median delay of each candidate threshold; a case is detected by the first step above it within six hours."""
    g, c = grid(spark, sf), cases(spark, sf)
    taus = spark.createDataFrame([(x,) for x in TAUS], "tau double")
    k = detection.confusion_at(detection.labelled_grid(g, c), taus)
    steps = c.select("case_id", F.col("t").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(36))).alias("k")).select("case_id", "at", (F.floor(F.col("at") / 600) * 600 + 600 * F.col("k")).alias("t"))
    d = steps.join(g.select("t", "score"), "t").join(F.broadcast(taus)).where("score > tau").groupBy("tau", "case_id").agg((F.min("t") - F.min("at")).alias("delay"))
    m = d.groupBy("tau").agg(F.count("*").alias("detected"), F.percentile("delay", F.lit(0.5)).alias("median_delay"))
    share = lambda a, b: maths.div0(F.col(a), F.col(a) + F.col(b))
    k = k.select("tau", share("tp", "fp").alias("p"), share("tp", "fn").alias("r"), share("fp", "tn").alias("f")).join(m, "tau", "left")
    return k.select("tau", R6("p").alias("precision"), R6("r").alias("recall"), R6(maths.f1(F.col("p"), F.col("r"))).alias("f1"), R6("f").alias("fpr"), F.coalesce("detected", F.lit(0)).alias("detected"), "median_delay")


@query("pre_post_profile", "WITH " + TEL + f", p AS (SELECT user_id, avg(value) FILTER (WHERE t < {BOUNDARY}) AS a, max(value) FILTER (WHERE t < {BOUNDARY}) AS am, avg(value) FILTER (WHERE t >= {BOUNDARY}) AS b, max(value) FILTER (WHERE t >= {BOUNDARY}) AS bm, min(t) FILTER (WHERE t >= {BOUNDARY} AND value > 90) AS first_crossing, avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END) FILTER (WHERE t >= {BOUNDARY}) AS f FROM tel GROUP BY user_id) SELECT user_id, round(a, 6) AS pre_mean, round(am, 6) AS pre_max, round(b, 6) AS post_mean, round(bm, 6) AS post_max, first_crossing, round(f, 6) AS fraction_above, round(b / greatest(a, 1e-9), 6) AS ratio FROM p")
def _(spark, sf):
    late, v = F.col("t") >= BOUNDARY, F.col("value")
    on = lambda c, x: F.when(c, x)
    p = tel(spark, sf).groupBy("user_id").agg(F.avg(on(~late, v)).alias("a"), F.max(on(~late, v)).alias("am"), F.avg(on(late, v)).alias("b"), F.max(on(late, v)).alias("bm"), F.min(on(late & (v > 90), F.col("t"))).alias("first_crossing"), F.avg(on(late, (v > 90).cast("double"))).alias("f"))
    return p.select("user_id", R6("a").alias("pre_mean"), R6("am").alias("pre_max"), R6("b").alias("post_mean"), R6("bm").alias("post_max"), "first_crossing", R6("f").alias("fraction_above"), R6(F.col("b") / F.when(F.col("a").isNotNull(), F.greatest(F.col("a"), F.lit(1e-9)))).alias("ratio"))


Z = T + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM ten GROUP BY dim), z AS (SELECT vec_id, dim, abs((v - m) / sd) AS a FROM ten JOIN s USING (dim))"


def scaled(spark, sf):
    x = ten(spark, sf)
    return profile.transform(x, profile.fit_scaler(x, ["dim"]), ["dim"]).withColumn("a", F.abs("z"))


@query("outlier_rows", Z + " SELECT count(*) FILTER (WHERE a > 3) AS n_cells, count(DISTINCT vec_id) FILTER (WHERE a > 3) AS n_rows, count(DISTINCT vec_id) AS n FROM z")
def _(spark, sf):
    r = scaled(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("a") > 3).alias("c"))
    return r.agg(F.sum("c").alias("n_cells"), F.count_if(F.col("c") > 0).alias("n_rows"), F.count("*").alias("n"))


@query("outlier_top", Z + " SELECT dim, place, vec_id, round(a, 5) AS a FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY a DESC, vec_id) AS place FROM z) WHERE place <= 5")
def _(spark, sf):
    w = W.partitionBy("dim").orderBy(F.desc("a"), "vec_id")
    return scaled(spark, sf).withColumn("place", F.row_number().over(w)).where("place <= 5").select("dim", F.col("place").cast("long").alias("place"), "vec_id", F.round("a", 5).alias("a"))


@query("top_columns_in_window", T + " SELECT dim, round(max(abs(v)), 6) AS most FROM ten WHERE vec_id >= 100 AND vec_id < 400 GROUP BY dim ORDER BY max(abs(v)) DESC, dim LIMIT 5")
def _(spark, sf):
    m = ten(spark, sf).where("vec_id >= 100 and vec_id < 400").groupBy("dim").agg(F.max(F.abs("v")).alias("m"))
    return m.orderBy(F.desc("m"), "dim").limit(5).select("dim", R6("m").alias("most"))


@query("rolling_max_period", "WITH " + GRID + f", p AS (SELECT t, score, t >= {BOUNDARY} AS late FROM grid) SELECT t, late, round(max(score) OVER (PARTITION BY late ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW), 6) AS rolled FROM p")
def _(spark, sf):
    """The rolling maximum never reaches back into another period."""
    g = grid(spark, sf).withColumn("late", F.col("t") >= BOUNDARY)
    return intervals.rolling_max(g, "score", 600, keys=("late",)).select("t", "late", R6("rolled").alias("rolled"))


FIT_END, TEST = 1704931200, 1705536000
PERIOD = f"CASE WHEN target < {FIT_END} THEN 'fit' WHEN start >= {FIT_END} AND target < {TEST} THEN 'calibration' WHEN start >= {TEST} THEN 'test' ELSE 'crossing' END"


@query("scoring_set", f"WITH wc AS ({sql_of('window_categories')}), w AS (SELECT *, {PERIOD} AS period FROM wc), d AS (SELECT *, target - lag(target) OVER (PARTITION BY period ORDER BY target) AS step FROM w), sw AS ({sql_of('sliding_windows')}), a AS (SELECT period, count(*) AS approved FROM sw GROUP BY period) SELECT d.period, count(*) AS windows, count(*) FILTER (WHERE category = 'event_associated') AS event_associated, count(*) FILTER (WHERE category = 'ignore') AS ignored, count(*) FILTER (WHERE category = 'normal_reference') AS normal_reference, count(*) FILTER (WHERE ambiguous) AS ambiguous_dropped, count(DISTINCT case_id) AS cases, count(DISTINCT target) = count(*) AS unique_targets, coalesce(bool_and(step = 600), true) AS contiguous, count(*) = max(approved) AS as_approved FROM d JOIN a ON a.period = d.period GROUP BY d.period")
def _(spark, sf):
    """The windows that a period is scored on, against the number approved for it; equal targets or other counts would be an error."""
    w = intervals.windows(grid(spark, sf), 7, 600)
    c = detection.window_categories(w, cases(spark, sf), match=(59, 300), guard=(179, 600)).withColumn("period", F.expr(PERIOD))
    c = intervals.with_previous(c, "target", ("target",), ["period"], "prev")
    n = lambda on, name: F.count_if(on).alias(name)
    kind = F.col("category")
    out = c.groupBy("period").agg(
        F.count("*").alias("windows"), n(kind == "event_associated", "event_associated"), n(kind == "ignore", "ignored"), n(kind == "normal_reference", "normal_reference"), n(F.col("ambiguous"), "ambiguous_dropped"), F.count_distinct("case_id").alias("cases"),
        (F.count_distinct("target") == F.count("*")).alias("unique_targets"), F.coalesce(F.every(F.col("target") - F.col("prev") == 600), F.lit(True)).alias("contiguous"),
    )
    approved = w.groupBy(F.expr(PERIOD).alias("period")).agg(F.count("*").alias("approved"))
    return out.join(approved, "period").withColumn("as_approved", F.col("windows") == F.col("approved")).drop("approved")


RULE = [("vm", "node-", {"metric": "system."}), ("pod", None, {"metric": "kpi_container.", "trace": "", "log": ""})]
NODE = "CASE WHEN s_suppkey % 5 = 0 THEN 'node-' ELSE 'pod-' END || s_suppkey"
CHANNEL = "CASE WHEN dim < 20 THEN 'system.' WHEN dim < 44 THEN 'kpi_container.' ELSE 'span.' END || dim"


@query("declared_mask", f"WITH n AS (SELECT CASE WHEN starts_with({NODE}, 'node-') THEN 'vm' ELSE 'pod' END AS type FROM supplier), d AS (SELECT unnest(range(64)) AS dim), c AS (SELECT {CHANNEL} AS channel, CASE WHEN dim < 44 THEN 'metric' WHEN dim < 54 THEN 'trace' ELSE 'log' END AS modality FROM d), r AS (SELECT * FROM (VALUES ('vm', 'metric', 'system.'), ('pod', 'metric', 'kpi_container.'), ('pod', 'trace', ''), ('pod', 'log', '')) v(type, modality, prefix)) SELECT type, modality, count(DISTINCT k) AS nodes, count(DISTINCT channel) AS channels, count(*) AS applicable FROM (SELECT n.type, row_number() OVER () AS k FROM n) JOIN r USING (type) JOIN c USING (modality) WHERE starts_with(channel, prefix) GROUP BY type, modality")
def _(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.expr(NODE).alias("node"))
    kind = "CASE WHEN dim < 44 THEN 'metric' WHEN dim < 54 THEN 'trace' ELSE 'log' END"
    channels = spark.range(64).selectExpr("id as dim").select(F.expr(CHANNEL).alias("channel"), F.expr(kind).alias("modality"))
    return diagnostics.declared_mask(nodes, channels, RULE)


@query("collate_optional", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, coalesce(quality >= 0, false) AS quality_present, coalesce(toxic >= 0, false) AS toxic_present FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").distinct().join(table(spark, sf, "labels"), "doc_id", "left")
    return diagnostics.collated(d.select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query("stable_json", "WITH s AS (SELECT s_nationkey AS k, s_suppkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), l AS (SELECT k, i // 4 AS r, max(n) AS n, string_agg(v::VARCHAR, ', ' ORDER BY i) AS line FROM s GROUP BY k, i // 4) SELECT k, '{' || chr(10) || '  \"nation\": ' || k || ',' || chr(10) || '  \"suppliers\": ' || CASE WHEN max(n) <= 4 THEN '[' || max(line) || ']' ELSE '[' || chr(10) || string_agg('    ' || line, ',' || chr(10) ORDER BY r) || chr(10) || '  ]' END || chr(10) || '}' AS text FROM l GROUP BY k")
def _(spark, sf):
    """A manifest as text that doesn't change from run to run; long lists of numbers are wrapped."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("v"))
    text = F.concat(F.lit('{\n  "nation": '), F.col("k").cast("string"), F.lit(',\n  "suppliers": '), diagnostics.wrapped_ints(F.col("v"), 4), F.lit("\n}"))
    return s.select("k", text.alias("text"))


@query("tensor_digest", T + " SELECT label, count(*) AS n, sum(('0x' || substr(md5(vec_id || '-' || dim || '-' || round(v * 1000000)::BIGINT), 1, 8))::BIGINT)::BIGINT AS digest FROM ten GROUP BY label")
def _(spark, sf):
    """A digest of all entries of a tensor that doesn't depend on their order or place: a sum of hashes, and their number."""
    h = F.md5(F.concat_ws("-", F.col("vec_id").cast("string"), F.col("dim").cast("string"), F.round(F.col("v") * 1_000_000).cast("long").cast("string")))
    return ten(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(h, 1, 8), 16, 10).cast("long")).alias("digest"))


#: One pass over a grid of ratios of shape to scale: the likeliest place of each key.
TAIL_PASS = (
    ", t{0} AS (SELECT k, m, top, place + j * {1} AS place, CASE WHEN place + j * {1} < 0 THEN (1 / pow(10, abs(place + j * {1}) / 4000) - 1) / top ELSE (pow(10, (place + j * {1}) / 4000) - 1) / m END AS ratio FROM b{2}, unnest(range(-{3}, {3} + 1)) u(j))"
    ", g{0} AS (SELECT k, m, top, place, ratio, avg(ln(1 + ratio * y)) AS gamma FROM o JOIN t{0} USING (k) GROUP BY ALL), f{0} AS (SELECT *, CASE WHEN place = 0 THEN m ELSE gamma / ratio END AS sigma FROM g{0})"
    ", b{0} AS (SELECT k, m, top, place, gamma, sigma FROM f{0} WHERE place = 0 OR gamma >= -0.5 QUALIFY row_number() OVER (PARTITION BY k ORDER BY -ln(sigma) - gamma DESC, place) = 1)"
)
TAIL = (
    "WITH q AS (SELECT event_type AS k, count(value) AS n, quantile_cont(value, 0.98) AS t, quantile_cont(value, 0.999) AS p FROM events GROUP BY 1), o AS MATERIALIZED (SELECT k, value - t AS y FROM events JOIN q ON k = event_type WHERE value > t)"
    ", e AS (SELECT k, count(*) AS n_over, avg(y) AS m, max(y) AS top, min(y) AS low FROM o GROUP BY k), b0 AS (SELECT k, m, top, 0 AS place FROM e WHERE n_over >= 10 AND top > low)"
    + "".join(TAIL_PASS.format(k, width, k - 1, steps) for k, (width, steps) in enumerate(diagnostics.TAIL_PASSES, 1))
    + " SELECT q.k AS event_type, n, round(t, 6) AS start, coalesce(n_over, 0) AS n_over, round(gamma, 4) AS gamma, round(CASE WHEN sigma IS NULL THEN p WHEN place = 0 THEN t - sigma * ln(0.001 * n / n_over) ELSE t + sigma / gamma * (pow(0.001 * n / n_over, -gamma) - 1) END, 4) AS threshold, sigma IS NULL AS fallback FROM q LEFT JOIN e USING (k) LEFT JOIN (SELECT k, place, gamma, sigma FROM b3) b USING (k)"
)


@query("tail_thresholds", TAIL)
def _(spark, sf):
    x = table(spark, sf, "events").select("event_type", "value")
    return diagnostics.tail_threshold(x, ["event_type"], "value").select("event_type", "n", R6("start").alias("start"), "n_over", F.round("gamma", 4).alias("gamma"), F.round("threshold", 4).alias("threshold"), "fallback")


WEIGHTS = np.array([[((d * 7 + k * 3) % 11 - 5) / 10 for k in range(5)] for d in range(64)])


@query("model_forward", T + ", z AS (SELECT vec_id, k, sum(v * (((dim * 7 + k * 3) % 11 - 5) / 10.0::DOUBLE)) AS z FROM ten, unnest(range(5)) u(k) GROUP BY vec_id, k), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e) SELECT vec_id, arg_max(k, p)::INTEGER AS pred, round(max(p), 6) AS p FROM p GROUP BY vec_id")
def _(spark, sf):
    """A model of fixed weights over whole batches of vectors, by the door to external models."""

    def forward(x: np.ndarray) -> np.ndarray:
        z = x @ WEIGHTS
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    p = table(spark, sf, "embeddings").select("vec_id", models.predictor(forward)(F.col("embedding").cast("array<double>")).alias("p"))
    return p.select("vec_id", maths.argmax(F.col("p")).cast("int").alias("pred"), R6(F.array_max("p")).alias("p"))


TOKENS = networks.core_weights(7, d=4, steps=4, types=2, classes=5, channels=3)


@query("network_forward")
def _(spark, sf):
    """A vector as four minutes of two nodes with two tokens of four numbers each, through attention over time and nodes and the head of faults.

    A token that begins with a negative number isn't there; a node whose tokens are all missing isn't valid.
    """

    def forward(x: np.ndarray) -> np.ndarray:
        tokens = x.reshape(-1, 4, 2, 2, 4)
        there = tokens[..., 0] >= 0
        valid = there.any((1, 3))
        h = networks.core(TOKENS, tokens, there, np.array([0, 1]), valid, heads=2, layers=1)
        z = networks.fault_logits(TOKENS, h, valid)
        e = np.exp(z - z.max(1, keepdims=True))
        ahead = networks.next_values(TOKENS, h, np.array([0, 1]), valid)
        return np.concatenate([e / e.sum(1, keepdims=True), ahead.reshape(len(x), -1)], axis=1)

    p = table(spark, sf, "embeddings").select("vec_id", models.predictor(forward)(F.col("embedding").cast("array<double>")).alias("p"))
    share = F.slice("p", 1, 5)
    return p.select("vec_id", maths.argmax(share).cast("int").alias("pred"), R6(F.array_max(share)).alias("p"), F.transform(F.slice("p", 6, 6), lambda v: F.round(v, 6)).alias("ahead"))


REBUILD = networks.autoencoder_weights(11, inputs=4, hidden=6, layers=2, latent=3)


@query("reconstruction_errors")
def _(spark, sf):
    """A vector as sixteen steps of four numbers: its squared errors after an LSTM autoencoder, a step each, by the scoring rules."""

    def errors(x: np.ndarray) -> np.ndarray:
        steps = x.reshape(-1, 16, 4)
        return ((networks.rebuilt(REBUILD, steps, layers=2) - steps) ** 2).mean(-1)

    e = table(spark, sf, "embeddings").select("vec_id", models.predictor(errors)(F.col("embedding").cast("array<double>")).alias("e"))
    return e.select("vec_id", *(R6(rule(F.col("e"))).alias(name) for name, rule in models.SCORING_RULES.items()))


EXPECTED = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "float", "origin": "string"}


@query("schema_report", "SELECT unnest(['missing origin', 'ts is timestamp_ntz, not timestamp', 'unexpected props', 'value is double, not float']) AS issue WHERE (SELECT count(*) FROM (DESCRIBE events) WHERE column_name IN ('props', 'ts', 'value')) = 3")
def _(spark, sf):
    """What differs from an expected layout, as rows; it never raises."""
    return spark.createDataFrame([(x,) for x in checks.schema_issues(table(spark, sf, "events"), EXPECTED)], "issue string")


@query("require_mapped", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS category, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    """Each type's category; a type without one would be an error at run time."""
    known = spark.createDataFrame([("A", 0), ("N", 1), ("R", 2)], "l_returnflag string, category int")
    j = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).join(F.broadcast(known), "l_returnflag", "left")
    return wh.require(j, F.col("category").isNotNull(), "a type without a category").select("l_returnflag", "category", "n")
