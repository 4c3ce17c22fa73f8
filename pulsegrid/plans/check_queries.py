"""Queries on splits, leakage, masks, provenance and further summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import maths, trees
from pulsegrid.operators import checks, intervals, profile

from .registry import query
from .time_queries import RUNS
from .views import CASES, PROBS, TEL, TEN, cases, grid, logits, table, tel, ten

BOUNDARY, EMBARGO = 1704931200, 3600
T = "WITH " + TEN
R6 = lambda c: F.round(c, 6)


def roles(spark, sf):
    return checks.window_roles(intervals.windows(grid(spark, sf), 7, 600), BOUNDARY, EMBARGO)


ROLES = RUNS + f", w AS (SELECT t AS start, t + 3600 AS target, CASE WHEN t + 3600 < {BOUNDARY - EMBARGO} THEN 'fit' WHEN t >= {BOUNDARY} THEN 'validation' ELSE 'embargo' END AS role FROM rn WHERE k <= len - 6)"
CASE_ROLES = ROLES + (
    ", h AS (SELECT cs.case_id, coalesce(bool_or(w.role = 'fit'), false) AS in_fit, coalesce(bool_or(w.role = 'validation'), false) AS in_validation FROM cs LEFT JOIN w ON cs.t BETWEEN w.start AND w.target GROUP BY cs.case_id)"
    ", cr AS (SELECT *, CASE WHEN in_fit AND in_validation THEN 'both' WHEN in_fit THEN 'fit' WHEN in_validation THEN 'validation' ELSE 'none' END AS role FROM h)"
)


@query("case_roles", CASE_ROLES + " SELECT * FROM cr")
def _(spark, sf):
    return checks.case_roles(roles(spark, sf), cases(spark, sf), 3600)


@query("leakage_checks", CASE_ROLES + (
    ", m AS (SELECT m, bool_or(role = 'fit') AS f, bool_or(role = 'validation') AS v FROM (SELECT role, unnest(range(start, target + 1, 600)) AS m FROM w) GROUP BY m)"
    f", c AS (SELECT 'fit_reaches_embargo' AS \"check\", count(*) FILTER (WHERE role = 'fit' AND target >= {BOUNDARY - EMBARGO}) AS violations FROM w UNION ALL SELECT 'validation_starts_early', count(*) FILTER (WHERE role = 'validation' AND start < {BOUNDARY}) FROM w"
    f" UNION ALL SELECT 'crosses_boundary', count(*) FILTER (WHERE role <> 'embargo' AND start < {BOUNDARY} AND target >= {BOUNDARY}) FROM w UNION ALL SELECT 'empty_side', 2 - count(DISTINCT role) FILTER (WHERE role <> 'embargo') FROM w"
    " UNION ALL SELECT 'shared_moments', count(*) FILTER (WHERE f AND v) FROM m UNION ALL SELECT 'case_on_both_sides', count(*) FILTER (WHERE role = 'both') FROM cr UNION ALL SELECT 'repeated_window', count(*) - count(DISTINCT start) FROM w)"
    " SELECT \"check\", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM c"
))
def _(spark, sf):
    return checks.leakage(roles(spark, sf), cases(spark, sf), BOUNDARY, EMBARGO, 600, 3600)


@query("role_summary", ROLES + " SELECT role, count(*) AS n, min(start) AS first_start, max(target) AS last_target FROM w GROUP BY role")
def _(spark, sf):
    return roles(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("target").alias("last_target"))


@query("approved_counts", "WITH f AS (SELECT event_type, count(*) AS found FROM events WHERE event_type <> 'signup' GROUP BY event_type), a AS (SELECT event_type, count(*) + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS approved FROM events WHERE event_type <> 'click' GROUP BY event_type) SELECT coalesce(f.event_type, a.event_type) AS event_type, found, approved, CASE WHEN found IS NULL THEN 'missing' WHEN approved IS NULL THEN 'unexpected' WHEN found = approved THEN 'ok' ELSE 'differs' END AS status FROM f FULL JOIN a ON f.event_type = a.event_type")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    approved = n.where("event_type <> 'click'").withColumn("n", F.col("n") + F.when(F.col("event_type") == "view", 1).otherwise(0))
    return checks.against(n.where("event_type <> 'signup'"), approved, ["event_type"])


@query("scaler_provenance", T + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM ten WHERE label < 5 GROUP BY dim), o AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM ten WHERE label <= 5 GROUP BY dim) SELECT 'not_finite_or_positive' AS \"check\", count(*) FILTER (WHERE NOT isfinite(m) OR NOT isfinite(sd) OR sd <= 0) AS violations FROM s UNION ALL SELECT 'same_as_fit_set', count(*) FILTER (WHERE abs(s.m - f.m) > 1e-9) FROM s JOIN s f ON s.dim = f.dim UNION ALL SELECT 'other_fit_set', count(*) FILTER (WHERE abs(s.m - o.m) > 1e-9) FROM s JOIN o ON s.dim = o.dim")
def _(spark, sf):
    fit = lambda where: profile.fit_scaler(ten(spark, sf).where(where), ["dim"])
    used = fit("label < 5")
    sane = checks.rows_of(used, not_finite_or_positive=F.count_if(maths.finite_or_null(F.col("mean")).isNull() | maths.finite_or_null(F.col("scale")).isNull() | (F.col("scale") <= 0)))
    gap = lambda where, name: checks.rows_of(used.join(fit(where).select("dim", F.col("mean").alias("other")), "dim"), **{name: F.count_if(F.abs(F.col("mean") - F.col("other")) > 1e-9)})
    return sane.union(gap("label < 5", "same_as_fit_set")).union(gap("label <= 5", "other_fit_set"))


@query("mask_stability", "WITH " + TEL + f", p AS (SELECT *, CASE WHEN t < {BOUNDARY} THEN 'before' ELSE 'after' END AS period FROM tel), k AS (SELECT DISTINCT user_id, channel FROM p WHERE period = 'before' AND value <> 0) SELECT period, count(*) AS n, count(*) FILTER (WHERE value <> 0 AND k.user_id IS NULL) AS outside FROM p LEFT JOIN k ON p.user_id = k.user_id AND p.channel = k.channel GROUP BY period")
def _(spark, sf):
    p = tel(spark, sf).withColumn("period", F.when(F.col("t") < BOUNDARY, "before").otherwise("after"))
    mask = p.where("period = 'before' and value <> 0").select("user_id", "channel").distinct().withColumn("live", F.lit(True))
    return p.join(mask, ["user_id", "channel"], "left").groupBy("period").agg(F.count("*").alias("n"), F.count_if((F.col("value") != 0) & F.col("live").isNull()).alias("outside"))


#: A control and fifteen deliberate changes of the columns value, channel, t and user_id; the columns that a change leaves out stay.
CORRUPT = {
    "clean": {}, "value_lost": {"value": "CASE WHEN event_id % 50 <> 0 THEN value END"}, "value_nan": {"value": "CASE WHEN event_id % 40 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"},
    "value_infinite": {"value": "CASE WHEN event_id % 60 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"}, "sign_flipped": {"value": "-value"}, "unit_changed": {"value": "value * 1000"}, "channel_renamed": {"channel": "upper(channel)"},
    "channel_lost": {"channel": "CASE WHEN event_id % 30 <> 0 THEN channel END"}, "channel_blank": {"channel": "CASE WHEN event_id % 20 = 0 THEN '' ELSE channel END"}, "channel_cut": {"channel": "substr(channel, 1, 4)"},
    "clock_behind": {"t": "t - 86400"}, "clock_ahead": {"t": "t + 100000000"}, "clock_lost": {"t": "CASE WHEN event_id % 25 <> 0 THEN t END"}, "clock_in_milliseconds": {"t": "t * 1000"}, "user_lost": {"user_id": "CASE WHEN event_id % 15 <> 0 THEN user_id END"},
    "user_negative": {"user_id": "-user_id - 1"},
}
RULES = {
    "null_value": "value IS NULL", "value_not_a_number": "isnan(value)", "value_beyond_bound": "abs(value) > 10000 AND NOT isnan(value)", "negative_value": "value < 0", "null_channel": "channel IS NULL",
    "unknown_channel": "channel NOT IN ('click', 'error', 'purchase', 'signup', 'view')", "null_time": "t IS NULL", "too_early": "t < 1704067200", "too_late": "t >= 1800000000", "null_user": "user_id IS NULL", "negative_user": "user_id < 0",
}
COLUMNS = ("value", "channel", "t", "user_id")


@query("corruption_suite", "WITH " + TEL + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS corruption, " + ", ".join(f"{x.get(c, c)} AS {c}" for c in COLUMNS) + " FROM tel" for n, x in CORRUPT.items()) + ") " + " UNION ALL ".join(f"SELECT corruption, '{n}' AS \"check\", count(*) FILTER (WHERE {s}) AS violations FROM c GROUP BY corruption" for n, s in RULES.items()))
def _(spark, sf):
    v, ch, t, u, e = (F.col(c) for c in ("value", "channel", "t", "user_id", "event_id"))
    changes = {
        "clean": {}, "value_lost": {"value": F.when(e % 50 != 0, v)}, "value_nan": {"value": F.when(e % 40 == 0, float("nan")).otherwise(v)}, "value_infinite": {"value": F.when(e % 60 == 0, float("inf")).otherwise(v)}, "sign_flipped": {"value": -v},
        "unit_changed": {"value": v * 1000}, "channel_renamed": {"channel": F.upper(ch)}, "channel_lost": {"channel": F.when(e % 30 != 0, ch)}, "channel_blank": {"channel": F.when(e % 20 == 0, "").otherwise(ch)}, "channel_cut": {"channel": F.substring(ch, 1, 4)},
        "clock_behind": {"t": t - 86400}, "clock_ahead": {"t": t + 100_000_000}, "clock_lost": {"t": F.when(e % 25 != 0, t)}, "clock_in_milliseconds": {"t": t * 1000}, "user_lost": {"user_id": F.when(e % 15 != 0, u)}, "user_negative": {"user_id": -u - 1},
    }
    known = ("click", "error", "purchase", "signup", "view")
    rules = {
        "null_value": lambda c: c["value"].isNull(), "value_not_a_number": lambda c: F.isnan(c["value"]), "value_beyond_bound": lambda c: (F.abs(c["value"]) > 10_000) & ~F.isnan(c["value"]), "negative_value": lambda c: c["value"] < 0,
        "null_channel": lambda c: c["channel"].isNull(), "unknown_channel": lambda c: ~c["channel"].isin(*known), "null_time": lambda c: c["t"].isNull(), "too_early": lambda c: c["t"] < 1704067200, "too_late": lambda c: c["t"] >= 1_800_000_000,
        "null_user": lambda c: c["user_id"].isNull(), "negative_user": lambda c: c["user_id"] < 0,
    }
    return checks.corrupted(tel(spark, sf), changes, rules)


@query("order_issues", "SELECT count(*) AS n, count(*) FILTER (WHERE p >= l_linenumber) AS out_of_order, count(*) FILTER (WHERE p IS NULL AND l_linenumber <> 1) AS bad_start FROM (SELECT l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS p FROM lineitem)")
def _(spark, sf):
    p = F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber"))
    li, n = table(spark, sf, "lineitem").select("l_linenumber", p.alias("p")), F.col("l_linenumber")
    return li.agg(F.count("*").alias("n"), F.count_if(F.col("p") >= n).alias("out_of_order"), F.count_if(F.col("p").isNull() & (n != 1)).alias("bad_start"))


@query("cv_folds", "WITH " + CASES + ", d AS (SELECT *, t // 86400 AS day FROM cs) SELECT day, (day % 5) AS fold, count(*) AS n, count(DISTINCT class) AS n_classes FROM d GROUP BY day")
def _(spark, sf):
    d = cases(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    return d.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("class").alias("n_classes")).select("day", (F.col("day") % 5).alias("fold"), "n", "n_classes")


@query("seeded_split", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7-' || s_nationkey || '-' || s_suppkey), s_suppkey) AS place FROM supplier) SELECT s_nationkey, s_suppkey, place, CASE WHEN place <= 3 THEN 'train' WHEN place <= 4 THEN 'validation' WHEN place <= 5 THEN 'test' END AS split FROM r")
def _(spark, sf):
    out = checks.seeded_split(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "7", (("train", 3), ("validation", 1), ("test", 1)))
    return out.select("s_nationkey", "s_suppkey", "place", "split")


@query("split_boundaries", "WITH " + CASES + ", s AS (SELECT CASE WHEN t < 1704931200 THEN 0 WHEN t < 1705276800 THEN 1 ELSE 2 END AS part, min(t) AS lo, max(t) AS hi FROM cs GROUP BY 1) SELECT * FROM (SELECT part, hi AS last_t, lead(lo) OVER (ORDER BY part) AS next_t, (hi + lead(lo) OVER (ORDER BY part)) // 2 AS boundary FROM s) WHERE next_t IS NOT NULL")
def _(spark, sf):
    part = F.when(F.col("t") < 1704931200, 0).when(F.col("t") < 1705276800, 1).otherwise(2)
    s = cases(spark, sf).groupBy(part.alias("part")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    s = s.select("part", F.col("hi").alias("last_t"), F.lead("lo").over(W.partitionBy(F.lit(0)).orderBy("part")).alias("next_t"))  # a row per part
    return s.where("next_t is not null").withColumn("boundary", F.floor((F.col("last_t") + F.col("next_t")) / 2))


@query("interval_gaps", "WITH " + CASES + ", g AS (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM (SELECT DISTINCT t FROM cs)) SELECT count(gap) AS n, min(gap) AS least, max(gap) AS most, quantile_cont(gap::DOUBLE, 0.5) AS median FROM g")
def _(spark, sf):
    g = intervals.with_previous(cases(spark, sf).select("t").distinct()).select((F.col("t") - F.col("prev")).alias("gap"))
    return g.agg(F.count("gap").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.percentile("gap", F.lit(0.5)).alias("median"))


@query("consecutive_fraction", RUNS + " SELECT count(*) AS n, round(coalesce(avg(CASE WHEN step = 600 THEN 1.0 ELSE 0.0 END), 1.0), 6) AS fraction FROM (SELECT t - lag(t) OVER (ORDER BY t) AS step FROM grid) WHERE step IS NOT NULL")
def _(spark, sf):
    g = intervals.with_previous(grid(spark, sf)).where("prev is not null")
    return g.agg(F.count("*").alias("n"), R6(F.coalesce(F.avg((F.col("t") - F.col("prev") == 600).cast("double")), F.lit(1.0))).alias("fraction"))


@query("window_values", RUNS + ", w AS (SELECT t AS start FROM rn WHERE k <= len - 6) SELECT w.start, count(*) - 1 AS n_inputs, max(CASE WHEN g.t = w.start THEN round(g.score, 6) END) AS first_input, max(round(g.score, 6)) FILTER (WHERE g.t < w.start + 3600) AS largest_input, max(CASE WHEN g.t = w.start + 3600 THEN round(g.score, 6) END) AS target, max(g.n) AS most FROM w JOIN grid g ON g.t BETWEEN w.start AND w.start + 3600 GROUP BY w.start")
def _(spark, sf):
    g = grid(spark, sf)
    w = intervals.windows(g, 7, 600).select("start", F.explode(F.sequence("start", "target", F.lit(600).cast("long"))).alias("t"))
    rows = w.join(g, "t").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("t", R6("score").alias("score"), "n"))).alias("s"))
    return rows.select("start", (F.size("s") - 1).cast("long").alias("n_inputs"), F.col("s.score")[0].alias("first_input"), F.array_max(F.slice("s.score", 1, 6)).alias("largest_input"), F.col("s.score")[6].alias("target"), F.array_max("s.n").alias("most"))


@query("objective_counts", "WITH " + TEL + f" SELECT count(*) FILTER (WHERE t < {BOUNDARY - EMBARGO} AND channel <> 'error') AS fit_normal, count(*) FILTER (WHERE t >= {BOUNDARY} AND channel <> 'error') AS validation_normal, count(*) FILTER (WHERE t >= {BOUNDARY} AND channel = 'error' AND user_id % 17 <> 0) AS validation_faults, count(*) FILTER (WHERE user_id % 17 = 0) AS ambiguous FROM tel")
def _(spark, sf):
    err, late = F.col("channel") == "error", F.col("t") >= BOUNDARY
    named = {"fit_normal": (F.col("t") < BOUNDARY - EMBARGO) & ~err, "validation_normal": late & ~err, "validation_faults": late & err & (F.col("user_id") % 17 != 0), "ambiguous": F.col("user_id") % 17 == 0}
    return tel(spark, sf).agg(*(F.count_if(c).alias(n) for n, c in named.items()))


@query("group_stats", T + ", c AS (SELECT label, dim, avg(CASE WHEN (label * 7 + dim) % 11 = 0 OR (dim % 9 = 4 AND vec_id % 50 > 0) THEN 1.0 ELSE 0.0 END) AS z FROM ten GROUP BY label, dim) SELECT label, count(*) AS n, count(*) FILTER (WHERE z = 1) AS all_zero, count(*) FILTER (WHERE z > 0.9) AS mostly_zero FROM c GROUP BY label")
def _(spark, sf):
    zero = ((F.col("label") * 7 + F.col("dim")) % 11 == 0) | ((F.col("dim") % 9 == 4) & (F.col("vec_id") % 50 > 0))
    c = profile.moments(ten(spark, sf).withColumn("v", F.when(zero, 0.0).otherwise(F.lit(1.0))), ["label", "dim"])
    return c.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("zero_fraction") == 1).alias("all_zero"), F.count_if(F.col("zero_fraction") > 0.9).alias("mostly_zero"))


@query("near_constant", "WITH u AS (SELECT p_brand, 'size' AS c, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_brand, 'price', p_retailprice::DOUBLE FROM part UNION ALL SELECT p_brand, 'level', 1000.0::DOUBLE + p_partkey % 3 FROM part UNION ALL SELECT p_brand, 'fixed', 5.0::DOUBLE FROM part) SELECT p_brand, c AS column_name, CASE WHEN stddev_samp(x) = 0 THEN 'constant' WHEN stddev_samp(x) / abs(avg(x)) < 0.01 THEN 'near' ELSE 'varies' END AS kind FROM u GROUP BY p_brand, c HAVING count(*) > 1")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), (1000.0 + F.col("p_partkey") % 3).alias("level"), F.lit(5.0).alias("fixed"))
    g = p.unpivot("p_brand", ["size", "price", "level", "fixed"], "column_name", "x").groupBy("p_brand", "column_name").agg(F.stddev_samp("x").alias("s"), F.avg("x").alias("m")).where("s is not null")
    return g.select("p_brand", "column_name", F.when(F.col("s") == 0, "constant").when(F.col("s") < 0.01 * F.abs("m"), "near").otherwise("varies").alias("kind"))


@query("global_extremes", T + ", c AS (SELECT label, dim, min(v) AS lo, max(v) AS hi, avg(v) AS m FROM ten GROUP BY label, dim) SELECT dim, round(min(lo), 6) AS least, round(max(hi), 6) AS most, round(avg(m), 6) AS mean_of_means FROM c GROUP BY dim")
def _(spark, sf):
    c = profile.moments(ten(spark, sf), ["label", "dim"])
    return c.groupBy("dim").agg(R6(F.min("lo")).alias("least"), R6(F.max("hi")).alias("most"), R6(F.avg("mean")).alias("mean_of_means"))


@query("extremes_by_grain", T + " SELECT modality, label, round(max(abs(v)), 6) AS most, count(*) AS n FROM tm GROUP BY GROUPING SETS ((modality), (label), ())")
def _(spark, sf):
    m, k = F.col("modality"), F.col("label")
    return ten(spark, sf).groupingSets([[m], [k], []], m, k).agg(R6(F.max(F.abs("v"))).alias("most"), F.count("*").alias("n"))


@query("outlier_summary", T + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM ten GROUP BY dim), z AS (SELECT vec_id, dim, abs((v - m) / sd) AS a FROM ten JOIN s USING (dim)) SELECT dim, count(*) FILTER (WHERE a > 3) AS n_cells, round(max(a), 5) AS most, arg_max(vec_id, a) AS worst FROM z GROUP BY dim")
def _(spark, sf):
    x = ten(spark, sf)
    a = profile.transform(x, profile.fit_scaler(x, ["dim"]), ["dim"]).withColumn("a", F.abs("z"))
    return a.groupBy("dim").agg(F.count_if(F.col("a") > 3).alias("n_cells"), F.round(F.max("a"), 5).alias("most"), F.max_by("vec_id", "a").alias("worst"))


@query("scaling_evidence", T + ", c AS (SELECT label % 2 AS region, dim, avg(v) AS m, stddev_pop(v) AS sd FROM ten GROUP BY 1, 2) SELECT region, count(*) AS n, round(quantile_cont(m, 0.5), 6) AS median_mean, round(quantile_cont(sd, 0.5), 6) AS median_std, count(*) FILTER (WHERE abs(m) < 0.05 AND abs(sd - 1) < 0.05) AS standardised FROM c GROUP BY region")
def _(spark, sf):
    c = profile.moments(ten(spark, sf).withColumn("region", F.col("label") % 2), ["region", "dim"])
    half = lambda x: R6(F.percentile(x, F.lit(0.5)))
    return c.groupBy("region").agg(F.count("*").alias("n"), half("mean").alias("median_mean"), half("std").alias("median_std"), F.count_if((F.abs("mean") < 0.05) & (F.abs(F.col("std") - 1) < 0.05)).alias("standardised"))


@query("missing_scenarios", T + ", s AS (SELECT vec_id % 5 AS seed, modality, sum(abs(v)) AS a, count(*) AS c FROM tm GROUP BY 1, 2), k AS (SELECT unnest(range(1, 8)) AS mask), b AS (SELECT mask, seed, sum(a) / sum(c) AS score FROM k JOIN s ON (mask >> CASE modality WHEN 'metric' THEN 0 WHEN 'trace' THEN 1 ELSE 2 END) & 1 = 1 GROUP BY mask, seed) SELECT mask, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM b GROUP BY mask")
def _(spark, sf):
    s = ten(spark, sf).groupBy((F.col("vec_id") % 5).alias("seed"), "modality").agg(F.sum(F.abs("v")).alias("a"), F.count("*").alias("c"))
    bit = F.when(F.col("modality") == "metric", 1).when(F.col("modality") == "trace", 2).otherwise(4)
    b = s.withColumn("mask", F.explode(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda m: m.bitwiseAND(bit) != 0)))  # the summary has a row per seed and modality
    b = b.groupBy("mask", "seed").agg((F.sum("a") / F.sum("c")).alias("score"))
    return b.groupBy(F.col("mask").cast("long").alias("mask")).agg(F.count("*").alias("n"), R6(F.avg("score")).alias("mean"), R6(F.stddev_samp("score")).alias("sd"))


@query("acceptance_tests", "WITH " + PROBS + ", f AS (SELECT vec_id % 4 AS fold, seed, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc FROM pred GROUP BY 1, 2), g AS (SELECT fold, avg(acc) AS m, stddev_samp(acc) AS sd, min(acc) AS worst FROM f GROUP BY fold) SELECT count(*) AS n_folds, round(avg(m), 6) AS mean, bool_and(m > 0.05) AS every_fold_above, avg(sd) < 0.1 AS stable, min(worst) > 0 AS never_zero FROM g")
def _(spark, sf):
    hit = (maths.argmax(F.col("z")) == F.col("label")).cast("double")
    f = logits(spark, sf).groupBy((F.col("vec_id") % 4).alias("fold"), "seed").agg(F.avg(hit).alias("acc"))
    g = f.groupBy("fold").agg(F.avg("acc").alias("m"), F.stddev_samp("acc").alias("sd"), F.min("acc").alias("worst"))
    return g.agg(F.count("*").alias("n_folds"), R6(F.avg("m")).alias("mean"), F.every(F.col("m") > 0.05).alias("every_fold_above"), (F.avg("sd") < 0.1).alias("stable"), (F.min("worst") > 0).alias("never_zero"))


@query("model_alignment", "WITH " + PROBS + ", a AS (SELECT vec_id, count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT pred) AS answers FROM pred GROUP BY vec_id) SELECT count(*) AS n, count(*) FILTER (WHERE n <> 5 OR labels <> 1) AS misaligned, count(*) FILTER (WHERE answers = 1) AS unanimous FROM a")
def _(spark, sf):
    a = logits(spark, sf).groupBy("vec_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct(maths.argmax(F.col("z"))).alias("answers"))
    return a.agg(F.count("*").alias("n_"), F.count_if((F.col("n") != 5) | (F.col("labels") != 1)).alias("misaligned"), F.count_if(F.col("answers") == 1).alias("unanimous")).withColumnRenamed("n_", "n")


@query("mapping_check", "WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_regionkey END AS r FROM nation WHERE n_nationkey >= 3) SELECT coalesce(a.k, b.k) AS k, a.r AS one, b.r AS two FROM a FULL JOIN b ON a.k = b.k WHERE a.r IS DISTINCT FROM b.r")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    a, b = n.where("k < 20").withColumnRenamed("r", "one"), n.where("k >= 3").select("k", F.when(F.col("k") % 6 != 0, F.col("r")).alias("two"))
    return a.join(b, "k", "full_outer").where(~F.col("one").eqNullSafe(F.col("two")))


@query("membership", "SELECT n_name, count(c_custkey) FILTER (WHERE o_custkey IS NOT NULL) AS inside, count(c_custkey) FILTER (WHERE o_custkey IS NULL) AS outside FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY n_name")
def _(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey")).distinct()
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("n_name").agg(F.count_if(F.col("o_custkey").isNotNull()).alias("inside"), F.count_if(F.col("o_custkey").isNull()).alias("outside"))


@query("hidden_blocks", T + f", m AS (SELECT vec_id, label, modality, v, substr(md5('3-' || vec_id || '-' || modality), 1, 6) < '{round(0.3 * 16**6):06x}' AS hidden FROM tm) SELECT label, modality, count(*) AS n, count(*) FILTER (WHERE hidden) AS n_hidden, round(avg(CASE WHEN hidden THEN 0.0 ELSE v END), 6) AS mean, bool_and(hidden) AS all_hidden FROM m GROUP BY label, modality")
def _(spark, sf):
    m = ten(spark, sf).withColumn("hidden", checks.mask_of([F.col("vec_id"), F.col("modality")], 0.3, "3"))
    return m.groupBy("label", "modality").agg(F.count("*").alias("n"), F.count_if("hidden").alias("n_hidden"), R6(F.avg(F.when(F.col("hidden"), 0.0).otherwise(F.col("v")))).alias("mean"), F.every("hidden").alias("all_hidden"))


@query("bytes_by_category", "SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


JSON = "CASE WHEN o_orderkey % 3 = 0 THEN '{\"run\":{\"test_case\":[' || o_orderkey || ',{\"label\":\"' || o_orderstatus || '\"}]}}' ELSE '{\"run\":{\"id\":' || o_custkey || '},\"label\":null}' END"


@query("json_keys", f"WITH j AS (SELECT o_orderkey, {JSON} AS j FROM orders) SELECT o_orderkey, t.fullkey AS path FROM j, json_tree(j.j) t WHERE regexp_matches(t.key, '^(test|label)')")
def _(spark, sf):
    j = table(spark, sf, "orders").select("o_orderkey", F.expr(JSON.replace("\\", "")).alias("j"))
    return trees.keys_like(j, ["o_orderkey"], "j", "^(test|label)")


@query("fault_names", "SELECT DISTINCT regexp_extract(x, '^(.*)_([^_/]+)/', 1) AS service, regexp_extract(x, '_(cpu|mem|delay|loss)/', 1) AS fault, CASE WHEN starts_with(x, 'node') THEN 'node' ELSE 'container' END AS family FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'node-' ELSE 'pod_' END || s_nationkey || '_' || CASE s_suppkey % 5 WHEN 0 THEN 'cpu' WHEN 1 THEN 'mem' WHEN 2 THEN 'delay' WHEN 3 THEN 'loss' ELSE 'other' END || '/1' AS x FROM supplier)")
def _(spark, sf):
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "cpu").when(k % 5 == 1, "mem").when(k % 5 == 2, "delay").when(k % 5 == 3, "loss").otherwise("other")
    x = F.concat(F.when(k % 4 == 0, "node-").otherwise("pod_"), F.col("s_nationkey").cast("string"), F.lit("_"), kind, F.lit("/1"))
    s = table(spark, sf, "supplier").select(x.alias("x"))
    return s.select(F.regexp_extract("x", "^(.*)_([^_/]+)/", 1).alias("service"), F.regexp_extract("x", "_(cpu|mem|delay|loss)/", 1).alias("fault"), F.when(F.col("x").startswith("node"), "node").otherwise("container").alias("family")).distinct()
