"""Queries on the feature tensor and classifier outputs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import maths
from pulsegrid.operators import classify, detection, profile, resample
from pulsegrid.operators.ordered import grid_quantiles

from .registry import query
from .views import PROBS, TEN, logits, table, tel, ten

T = "WITH " + TEN
P = "WITH " + PROBS


@query("channel_stats", T + " SELECT dim, modality, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, min(v) = max(v) AS constant FROM tm GROUP BY dim, modality")
def _(spark, sf):
    m = profile.moments(ten(spark, sf), ["dim", "modality"])
    return m.select("dim", "modality", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi", "zero_fraction")), "constant")


@query("zero_fraction", T + ", b AS (SELECT vec_id, modality, bool_and(v < 0) AS all_low, avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END) AS low FROM tm GROUP BY vec_id, modality) SELECT modality, round(avg(low), 6) AS low_fraction, round(avg(CASE WHEN all_low THEN 1.0 ELSE 0.0 END), 6) AS all_low_fraction FROM b GROUP BY modality")
def _(spark, sf):
    b = ten(spark, sf).groupBy("vec_id", "modality").agg(F.every(F.col("v") < 0).alias("a"), F.avg((F.col("v") < 0).cast("double")).alias("low"))
    return b.groupBy("modality").agg(F.round(F.avg("low"), 6).alias("low_fraction"), F.round(F.avg(F.col("a").cast("double")), 6).alias("all_low_fraction"))


ABSENT = T + ", x AS (SELECT label, dim, modality, CASE WHEN (label * 7 + dim) % 11 = 0 THEN 0.0 ELSE v END AS v FROM tm)"


@query("structural_absence", ABSENT + " SELECT label, dim, bool_and(v = 0) AS absent FROM x GROUP BY label, dim")
def _(spark, sf):
    x = ten(spark, sf).withColumn("v", F.when((F.col("label") * 7 + F.col("dim")) % 11 == 0, 0.0).otherwise(F.col("v")))
    return profile.structural_absence(x, ["label", "dim"])


@query("fit_scaler", T + " SELECT dim, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END, 6) AS scale FROM tm WHERE vec_id % 10 < 6 GROUP BY dim")
def _(spark, sf):
    return profile.fit_scaler(ten(spark, sf).where("vec_id % 10 < 6"), ["dim"]).select("dim", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("transform", T + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM tm WHERE vec_id % 10 < 6 GROUP BY dim) SELECT vec_id, dim, round(CASE WHEN dim % 16 = 0 THEN 0.0 ELSE (v - m) / sd END, 4) AS z FROM tm JOIN s USING (dim)")
def _(spark, sf):
    x = ten(spark, sf)
    absent = spark.range(64).where("id % 16 = 0").select(F.col("id").cast("int").alias("dim"))
    return profile.transform(x, profile.fit_scaler(x.where("vec_id % 10 < 6"), ["dim"]), ["dim"], absent).select("vec_id", "dim", F.round("z", 4).alias("z"))


@query("before_after_summary", T + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM tm WHERE vec_id % 10 < 6 GROUP BY dim), z AS (SELECT vec_id % 10 < 6 AS fit, v AS before, (v - m) / sd AS after FROM tm JOIN s USING (dim)), u AS (SELECT fit, 'before' AS stage, before AS x FROM z UNION ALL SELECT fit, 'after', after FROM z) SELECT fit, stage, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(quantile_cont(x, 0.01), 5) AS p01, round(quantile_cont(x, 0.99), 5) AS p99 FROM u GROUP BY fit, stage")
def _(spark, sf):
    x = ten(spark, sf)
    z = profile.transform(x, profile.fit_scaler(x.where("vec_id % 10 < 6"), ["dim"]), ["dim"])
    u = z.select((F.col("vec_id") % 10 < 6).alias("fit"), F.expr("stack(2, 'before', v, 'after', z) as (stage, x)"))
    q = F.percentile("x", F.array(F.lit(0.01), F.lit(0.99)))
    return u.groupBy("fit", "stage").agg((F.round(F.avg("x"), 5) + 0.0).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"), F.round(q[0], 5).alias("p01"), F.round(q[1], 5).alias("p99"))


@query("histogram", T + ", e AS (SELECT b AS bin, -6.0::DOUBLE + b * (12.0::DOUBLE / 60) AS lo_edge, -6.0::DOUBLE + (b + 1) * (12.0::DOUBLE / 60) AS hi_edge FROM unnest(range(60)) u(b)), x AS (SELECT least(greatest(v * 10, -6.0), 6.0) AS x FROM tm) SELECT e.bin, round(lo_edge, 9) AS lo_edge, round(hi_edge, 9) AS hi_edge, count(x.x) AS n FROM e LEFT JOIN x ON x.x >= lo_edge AND (x.x < hi_edge OR (bin = 59 AND x.x <= 6.0)) GROUP BY ALL")
def _(spark, sf):
    h = profile.histogram(ten(spark, sf).withColumn("x", F.col("v") * 10), "x", -6.0, 6.0, 60)
    return h.select("bin", F.round("lo_edge", 9).alias("lo_edge"), F.round("hi_edge", 9).alias("hi_edge"), "n")


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(max(l_extendedprice), 4) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.9), F.lit(0.99)))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("p50"), F.round(q[0], 4).alias("p90"), F.round(q[1], 4).alias("p99"), F.round(F.max("l_extendedprice"), 4).alias("hi"), F.count("*").alias("n"))


@query("quantile_profile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS hi, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    q = F.percentile("value", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    return table(spark, sf, "events").groupBy("event_type").agg(*(F.round(q[k], 6).alias(f"p{p}") for k, p in enumerate((50, 90, 95, 99))), F.round(F.max("value"), 6).alias("hi"), F.count("*").alias("n"))


CORR = T + ", c AS (SELECT a.dim AS i, b.dim AS j, corr(a.v, b.v) AS r FROM tm a JOIN tm b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2)"


@query("correlation", CORR + " SELECT i, j, round(r, 5) AS r FROM c")
def _(spark, sf):
    return profile.correlations(ten(spark, sf), "vec_id", "dim", "v").select("i", "j", F.round("r", 5).alias("r"))


@query("correlated_pairs", CORR + " SELECT i, j, round(r, 5) AS r FROM c WHERE abs(r) >= 0.12")
def _(spark, sf):
    return profile.correlations(ten(spark, sf), "vec_id", "dim", "v").where("abs(r) >= 0.12").orderBy(F.desc(F.abs("r"))).select("i", "j", F.round("r", 5).alias("r"))


@query("modality_correlation", CORR + ", f AS (SELECT i, j, r FROM c UNION ALL SELECT j, i, r FROM c UNION ALL SELECT d, d, 1.0 FROM unnest(range(64)) u(d)), k AS (SELECT CASE WHEN i < 44 THEN 'metric' WHEN i < 54 THEN 'trace' ELSE 'log' END AS a, CASE WHEN j < 44 THEN 'metric' WHEN j < 54 THEN 'trace' ELSE 'log' END AS b, r FROM f) SELECT a, b, round(avg(abs(r)), 5) AS mean_abs FROM k GROUP BY a, b")
def _(spark, sf):
    c = profile.correlations(ten(spark, sf), "vec_id", "dim", "v")
    f = c.union(c.select("j", "i", "r")).union(spark.range(64).select(F.col("id").cast("int"), F.col("id").cast("int"), F.lit(1.0)))
    kind = lambda x: F.when(F.col(x) < 44, "metric").when(F.col(x) < 54, "trace").otherwise("log")
    return f.groupBy(kind("i").alias("a"), kind("j").alias("b")).agg(F.round(F.avg(F.abs("r")), 5).alias("mean_abs"))


@query("feature_redundancy", CORR + ", f AS (SELECT i, r FROM c UNION ALL SELECT j, r FROM c) SELECT i AS dim, round(avg(abs(r)), 5) AS mean_abs FROM f GROUP BY i")
def _(spark, sf):
    c = profile.correlations(ten(spark, sf), "vec_id", "dim", "v")
    return c.select("i", "r").union(c.select("j", "r")).groupBy(F.col("i").alias("dim")).agg(F.round(F.avg(F.abs("r")), 5).alias("mean_abs"))


KS_P = "CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * exp(-2 * x * x) + (SELECT sum(2.0 * pow(-1, j - 1) * exp(-2.0 * j * j * x * x)) FROM unnest(range(2, 41)) u(j)), 0.0), 1.0) END"


@query("ks_shift", "WITH p AS (SELECT value AS v, ts < TIMESTAMP '2024-01-16' AS a FROM events), u AS (SELECT v, count(*) FILTER (WHERE a) AS x, count(*) FILTER (WHERE NOT a) AS y FROM p GROUP BY v), c AS (SELECT abs(sum(x) OVER w / sum(x) OVER () - sum(y) OVER w / sum(y) OVER ()) AS g FROM u WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), m AS (SELECT avg(v) FILTER (WHERE a) AS m1, avg(v) FILTER (WHERE NOT a) AS m2, stddev_pop(v) FILTER (WHERE a) AS s1, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM p), k AS (SELECT max(g) AS ks, any_value((m2 - m1) / s1) AS shift, max(g) * sqrt(any_value(na)::DOUBLE * any_value(nb) / (any_value(na) + any_value(nb))) AS x FROM c, m) SELECT round(ks, 6) AS ks, round(" + KS_P + ", 6) AS p_value, round(shift, 6) AS shift FROM k")
def _(spark, sf):
    p = table(spark, sf, "events").select(F.col("value").alias("v"), F.expr("ts < timestamp_ntz'2024-01-16 00:00:00'").alias("a"))
    m = p.agg(F.avg(F.when(F.col("a"), F.col("v"))).alias("m1"), F.avg(F.when(~F.col("a"), F.col("v"))).alias("m2"), F.stddev_pop(F.when(F.col("a"), F.col("v"))).alias("s1"))
    return profile.ks(p, "a", "v").crossJoin(m).select(F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"), F.round(F.try_divide(F.col("m2") - F.col("m1"), F.col("s1")), 6).alias("shift"))


@query("ks_flags", T + ", u AS (SELECT dim, v, count(*) FILTER (WHERE label < 5) AS x, count(*) FILTER (WHERE label >= 5) AS y FROM ten GROUP BY dim, v), c AS (SELECT dim, abs(sum(x) OVER w / sum(x) OVER a - sum(y) OVER w / sum(y) OVER a) AS g, sum(x) OVER a AS na, sum(y) OVER a AS nb FROM u WINDOW w AS (PARTITION BY dim ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY dim)), k AS (SELECT dim, max(g) AS ks, max(g) * sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS x FROM c GROUP BY dim) SELECT dim, round(ks, 6) AS ks, round(" + KS_P + ", 6) AS p_value FROM k WHERE ks >= 0.03 ORDER BY ks DESC, dim LIMIT 15")
def _(spark, sf):
    """The fifteen features whose two halves of the labels differ most, of those flagged by their statistic."""
    k = profile.ks(ten(spark, sf).withColumn("s", F.col("label") < 5), "s", "v", ("dim",)).where("ks >= 0.03")
    return k.orderBy(F.desc("ks"), "dim").limit(15).select("dim", F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"))


@query("kurtosis_outliers", "WITH m AS (SELECT l_returnflag AS k, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT l_returnflag, round(kurtosis_pop(l_extendedprice), 6) AS kurtosis, round(avg(CASE WHEN abs((l_extendedprice - m) / s) > 2 THEN 1.0 ELSE 0.0 END), 6) AS tail, round(max(abs((l_extendedprice - m) / s)), 6) AS max_z FROM lineitem JOIN m ON k = l_returnflag GROUP BY l_returnflag")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    z = profile.transform(li, profile.fit_scaler(li, ["l_returnflag"]), ["l_returnflag"])
    return z.groupBy("l_returnflag").agg(F.round(F.kurtosis("v"), 6).alias("kurtosis"), F.round(F.avg((F.abs("z") > 2).cast("double")), 6).alias("tail"), F.round(F.max(F.abs("z")), 6).alias("max_z"))


@query("describe", "SELECT channel, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS lo, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(max(value), 6) AS hi, count(DISTINCT value) AS distinct_values, round(skewness(value), 4) AS skew FROM (SELECT event_type AS channel, value FROM events) GROUP BY channel")
def _(spark, sf):
    n = F.count("value").cast("double")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)  # the bias-corrected form
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5)))
    return tel(spark, sf).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("lo"), F.round(q[0], 6).alias("p5"), F.round(q[1], 6).alias("p50"), F.round(F.max("value"), 6).alias("hi"), F.count_distinct("value").alias("distinct_values"), F.round(skew, 4).alias("skew"))


def preds(spark, sf):
    return logits(spark, sf).select("vec_id", "label", "seed", maths.argmax(F.col("z")).cast("int").alias("pred"))


CELLS = P + ", cells AS (SELECT a.k AS label, b.k AS pred, s.k AS seed FROM unnest(range(10)) a(k), unnest(range(10)) b(k), unnest(range(5)) s(k)), cf AS (SELECT c.seed, c.label, c.pred, count(p.vec_id) AS n FROM cells c LEFT JOIN pred p ON p.label = c.label AND p.pred = c.pred AND p.seed = c.seed GROUP BY ALL)"
CLASSES = CELLS + ", pc AS (SELECT seed, k, sum(n) FILTER (WHERE label = k AND pred = k) AS tp, sum(n) FILTER (WHERE label = k) AS sup, sum(n) FILTER (WHERE pred = k) AS prd FROM cf, unnest(range(10)) u(k) GROUP BY seed, k), pf AS (SELECT *, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pre, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc), ff AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM pf)"


@query("confusion", CELLS + " SELECT seed::INTEGER AS seed, label::INTEGER AS label, pred::INTEGER AS pred, n FROM cf")
def _(spark, sf):
    return classify.confusion(preds(spark, sf), 10, ("seed",))


@query("mean_confusion", CELLS + " SELECT label::INTEGER AS label, pred::INTEGER AS pred, round(avg(n), 6) AS n FROM cf GROUP BY label, pred")
def _(spark, sf):
    return classify.confusion(preds(spark, sf), 10, ("seed",)).groupBy("label", "pred").agg(F.round(F.avg("n"), 6).alias("n"))


@query("per_class_f1", CLASSES + " SELECT seed::INTEGER AS seed, k::INTEGER AS k, tp::BIGINT AS tp, sup::BIGINT AS support, prd::BIGINT AS predicted, round(pre, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM ff")
def _(spark, sf):
    c = classify.per_class(classify.confusion(preds(spark, sf), 10, ("seed",)), ("seed",))
    return c.select("seed", "k", "tp", "support", "predicted", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query("f1_summary", CLASSES + " SELECT seed::INTEGER AS seed, sum(sup)::BIGINT AS n, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1, round(avg(f1) FILTER (WHERE k <> 4), 6) AS macro_f1_excluding FROM ff GROUP BY seed")
def _(spark, sf):
    c = classify.per_class(classify.confusion(preds(spark, sf), 10, ("seed",)), ("seed",))
    ex = c.where("k <> 4").groupBy("seed").agg(F.round(F.avg("f1"), 6).alias("macro_f1_excluding"))
    return classify.summary(c, ("seed",)).select("seed", "n", *(F.round(x, 6).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1"))).join(ex, "seed")


@query("seed_mean_sd", CLASSES + ", s AS (SELECT seed, sum(tp) / sum(sup) AS acc, avg(f1) AS mf FROM ff GROUP BY seed) SELECT round(avg(acc), 6) AS mean_accuracy, round(stddev_samp(acc), 6) AS sd_accuracy, round(avg(mf), 6) AS mean_macro_f1, round(stddev_samp(mf), 6) AS sd_macro_f1 FROM s")
def _(spark, sf):
    s = classify.summary(classify.per_class(classify.confusion(preds(spark, sf), 10, ("seed",)), ("seed",)), ("seed",))
    return s.agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for c in ("accuracy", "macro_f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


@query("seed_subsets", P + ", m AS (SELECT unnest(range(1, 32)) AS mask), x AS (SELECT m.mask, pr.vec_id, pr.k, any_value(pr.label) AS label, round(avg(p), 12) AS q FROM m JOIN pr ON ((m.mask >> pr.seed) & 1) = 1 GROUP BY ALL), y AS (SELECT mask, vec_id, any_value(label) AS label, min(k) FILTER (WHERE q = mx) AS pred FROM (SELECT *, max(q) OVER (PARTITION BY mask, vec_id) AS mx FROM x) GROUP BY mask, vec_id) SELECT mask, bit_count(mask)::INTEGER AS size, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM y GROUP BY mask".replace("any_value(pr.label) AS label", "pr.label"))
def _(spark, sf):
    masks = spark.range(1, 32).withColumnRenamed("id", "mask")
    long = logits(spark, sf).select("vec_id", "label", "seed", F.posexplode(maths.softmax(F.col("z"))).alias("k", "p"))
    x = long.join(F.broadcast(masks), F.expr("(shiftright(mask, seed) & 1) = 1")).groupBy("mask", "vec_id", "label", "k").agg(F.round(F.avg("p"), 12).alias("q"))
    y = x.groupBy("mask", "vec_id", "label").agg(F.max(F.struct("q", (-F.col("k")).alias("nk"))).alias("b"))
    return y.groupBy("mask").agg(F.bit_count(F.first("mask")).alias("size"), F.round(F.avg((F.col("label") == -F.col("b.nk")).cast("double")), 6).alias("accuracy"))


@query("ensemble_argmax", P + ", x AS (SELECT vec_id, label, k, round(avg(p), 12) AS q FROM pr GROUP BY vec_id, label, k), y AS (SELECT vec_id, any_value(label) AS label, min(k) FILTER (WHERE q = mx)::INTEGER AS pred, round(max(q), 6) AS p FROM (SELECT *, max(q) OVER (PARTITION BY vec_id) AS mx FROM x) GROUP BY vec_id) SELECT vec_id, label, pred, p, label = pred AS correct FROM y")
def _(spark, sf):
    p = logits(spark, sf).select("vec_id", "label", maths.softmax(F.col("z")).alias("p"))
    m = classify.mean_probabilities(p, ["vec_id"]).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    pred = maths.argmax(F.col("p")).cast("int")
    return m.select("vec_id", "label", pred.alias("pred"), F.round(F.array_max("p"), 6).alias("p"), (F.col("label") == pred).alias("correct"))


@query("case_nll", P + " SELECT seed::INTEGER AS seed, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM pr WHERE k = label GROUP BY seed")
def _(spark, sf):
    p = logits(spark, sf).select("seed", maths.softmax(F.col("z"))[F.col("label")].alias("p"))
    return p.groupBy("seed").agg(F.round(F.avg(maths.nll(F.col("p"))), 6).alias("nll"))


@query("sigmoid_bce", T + " SELECT dim, round(avg(1 / (1 + exp(-v))), 6) AS p, round(avg(greatest(v, 0) - v * (label % 2) + ln(1 + exp(-abs(v)))), 6) AS bce FROM tm GROUP BY dim")
def _(spark, sf):
    return ten(spark, sf).groupBy("dim").agg(F.round(F.avg(maths.sigmoid(F.col("v"))), 6).alias("p"), F.round(F.avg(maths.bce_with_logits(F.col("v"), F.col("label") % 2)), 6).alias("bce"))


@query("family_diagnostic", P + ", f AS (SELECT CASE WHEN label < 6 THEN 'container' ELSE 'node' END AS tf, CASE WHEN pred < 6 THEN 'container' ELSE 'node' END AS pf, label = pred AS ok, seed FROM pred) SELECT seed::INTEGER AS seed, tf AS family, count(*) AS n, count(*) FILTER (WHERE ok) AS exact, count(*) FILTER (WHERE NOT ok AND tf = pf) AS inside, count(*) FILTER (WHERE tf <> pf) AS outside, round(CASE WHEN count(*) FILTER (WHERE tf = pf) > 0 THEN count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE tf = pf) ELSE 0.0 END, 6) AS conditional_accuracy FROM f GROUP BY seed, tf")
def _(spark, sf):
    fam = lambda c: F.when(F.col(c) < 6, "container").otherwise("node")
    f = preds(spark, sf).select("seed", fam("label").alias("family"), fam("pred").alias("pf"), (F.col("label") == F.col("pred")).alias("ok"))
    same = F.col("family") == F.col("pf")
    return f.groupBy("seed", "family").agg(F.count("*").alias("n"), F.count_if("ok").alias("exact"), F.count_if(~F.col("ok") & same).alias("inside"), F.count_if(~same).alias("outside"), F.round(maths.div0(F.count_if("ok"), F.count_if(same)), 6).alias("conditional_accuracy"))


@query("confusion_pairs", P + " SELECT label || ' -> ' || pred AS pair, count(*) AS n FROM pred WHERE label <> pred GROUP BY 1")
def _(spark, sf):
    return preds(spark, sf).where("label <> pred").groupBy(F.concat_ws(" -> ", F.col("label").cast("string"), F.col("pred").cast("string")).alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("seed_patterns", P + ", u AS (SELECT vec_id, count(*) FILTER (WHERE label <> pred) AS w FROM pred GROUP BY vec_id) SELECT CASE WHEN w = 5 THEN 'all' WHEN w > 1 THEN 'some' WHEN w = 1 THEN 'one' ELSE 'none' END AS pattern, count(*) AS units, sum(w)::BIGINT AS observations FROM u GROUP BY 1")
def _(spark, sf):
    u = preds(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("label") != F.col("pred")).alias("w"))
    word = F.when(F.col("w") == 5, "all").when(F.col("w") > 1, "some").when(F.col("w") == 1, "one").otherwise("none")
    return u.groupBy(word.alias("pattern")).agg(F.count("*").alias("units"), F.sum("w").alias("observations"))


BIN = "WITH b AS (SELECT n_chars AS s, toxic AS y FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL), u AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM b GROUP BY s)"


def binlab(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").where("toxic is not null").select(F.col("n_chars").alias("s"), F.col("toxic").alias("y"))


@query("auc_roc", BIN + ", c AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM u) SELECT sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, round(sum(u) / (sum(p) * sum(q)), 6) AS auc FROM c")
def _(spark, sf):
    return classify.auc_roc(binlab(spark, sf), "s", "y").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("auc_pr", BIN + ", c AS (SELECT p, sum(p) OVER w AS tp, sum(p + q) OVER w AS n FROM u WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * tp / n) / sum(p), 6) AS average_precision FROM c")
def _(spark, sf):
    return classify.average_precision(binlab(spark, sf), "s", "y").select(F.round("average_precision", 6).alias("average_precision"))


@query("binary_confusion", "SELECT count(*) FILTER (WHERE toxic = 1 AND n_chars > 2000) AS tp, count(*) FILTER (WHERE toxic = 0 AND n_chars > 2000) AS fp, count(*) FILTER (WHERE toxic = 1 AND n_chars <= 2000) AS fn, count(*) FILTER (WHERE toxic = 0 AND n_chars <= 2000) AS tn FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    y, h = F.col("y") == 1, F.col("s") > 2000
    return binlab(spark, sf).agg(F.count_if(y & h).alias("tp"), F.count_if(~y & h).alias("fp"), F.count_if(y & ~h).alias("fn"), F.count_if(~y & ~h).alias("tn"))


@query("class_weights", "WITH c AS (SELECT label, count(*) AS n_k FROM embeddings GROUP BY label) SELECT label, n_k, round(sum(n_k) OVER () / (count(*) OVER () * n_k), 6) AS weight FROM c")
def _(spark, sf):
    return classify.class_weights(table(spark, sf, "embeddings")).select("label", "n_k", F.round("weight", 6).alias("weight"))


@query("case_weights", "WITH w AS (SELECT vec_id, label, vec_id % 40 AS cid FROM embeddings), c AS (SELECT label, count(*) AS n_k FROM w GROUP BY label), cw AS (SELECT label, sum(n_k) OVER () / (count(*) OVER () * n_k) AS cw FROM c), n AS (SELECT cid, count(*) AS n_c FROM w GROUP BY cid), r AS (SELECT vec_id, cw / n_c AS x FROM w JOIN cw USING (label) JOIN n USING (cid)) SELECT vec_id, round(x / (SELECT avg(x) FROM r), 6) AS weight FROM r")
def _(spark, sf):
    w = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 40).alias("cid"))
    r = w.join(classify.class_weights(w), "label").join(w.groupBy("cid").agg(F.count("*").alias("n_c")), "cid").select("vec_id", (F.col("weight") / F.col("n_c")).alias("x"))
    return r.crossJoin(r.agg(F.avg("x").alias("m"))).select("vec_id", F.round(F.col("x") / F.col("m"), 6).alias("weight"))


@query("majority_class", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT min(label) AS label, any_value(n) AS n FROM c WHERE n = (SELECT max(n) FROM c)")
def _(spark, sf):
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.max(F.struct("n", (-F.col("label")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("label"), F.col("b.n").alias("n"))


ERR = T + ", c AS (SELECT vec_id, dim // 8 AS node, v, lead(v) OVER (PARTITION BY vec_id ORDER BY dim) AS nx, dim % 7 <> 0 AS mask, dim FROM tm), e AS (SELECT vec_id, node, coalesce(sum((v - coalesce(nx, 0)) ** 2) FILTER (WHERE mask AND (vec_id + node) % 9 <> 0) / nullif(count(*) FILTER (WHERE mask AND (vec_id + node) % 9 <> 0), 0), 0) AS error, count(*) FILTER (WHERE mask AND (vec_id + node) % 9 <> 0) > 0 AS valid FROM c GROUP BY vec_id, node)"
STAT = ERR + ", q AS (SELECT node, quantile_cont(error, 0.5) AS md, quantile_cont(error, 0.75) - quantile_cont(error, 0.25) AS iqr FROM e WHERE valid AND vec_id % 2 = 0 GROUP BY node), st AS (SELECT node, md, iqr, greatest(1e-6, 0.01 * (SELECT median(iqr) FROM q)) AS eps FROM q)"
SCORE = STAT + ", zz AS (SELECT vec_id, CASE WHEN valid THEN error END AS e, CASE WHEN valid THEN (error - md) / greatest(iqr, eps) END AS z FROM e JOIN st USING (node)), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC NULLS LAST) AS r FROM zz), sc AS (SELECT vec_id, coalesce(max(e), '-Infinity'::DOUBLE) AS m1, coalesce(max(z), '-Infinity'::DOUBLE) AS m2, coalesce(avg(z) FILTER (WHERE r <= 3), '-Infinity'::DOUBLE) AS m3 FROM rk GROUP BY vec_id)"


def errors(spark, sf):
    x = ten(spark, sf).withColumn("node", F.floor(F.col("dim") / 8))
    w = W.partitionBy("vec_id").orderBy("dim")
    cells = x.select("vec_id", "node", F.col("v").alias("target"), F.coalesce(F.lead("v").over(w), F.lit(0.0)).alias("predicted"), ((F.col("dim") % 7 != 0) & ((F.col("vec_id") + F.col("node")) % 9 != 0)).alias("mask"))
    return detection.node_errors(cells, ["vec_id", "node"])


@query("node_errors", ERR + " SELECT vec_id, node::BIGINT AS node, round(error, 8) AS error, valid FROM e")
def _(spark, sf):
    return errors(spark, sf).select("vec_id", "node", F.round("error", 8).alias("error"), "valid")


@query("calibration", STAT + " SELECT node::BIGINT AS node, round(md, 8) AS median, round(iqr, 8) AS iqr, round(greatest(iqr, eps), 8) AS scale, iqr < eps AS floored FROM st")
def _(spark, sf):
    s = detection.calibrate(errors(spark, sf).where("vec_id % 2 = 0"))
    return s.select("node", *(F.round(c, 8).alias(c) for c in ("median", "iqr", "scale")), "floored")


@query("window_scores", SCORE + " SELECT vec_id, round(m1, 6) AS m1, round(m2, 4) AS m2, round(m3, 4) AS m3 FROM sc")
def _(spark, sf):
    e = errors(spark, sf)
    s = detection.window_scores(e, detection.calibrate(e.where("vec_id % 2 = 0")), "vec_id")
    return s.select("vec_id", F.round("m1", 6).alias("m1"), F.round("m2", 4).alias("m2"), F.round("m3", 4).alias("m3"))


@query("thresholds", SCORE + ", t AS (SELECT unnest([95.0, 97.0, 99.0, 99.5]) AS p, unnest(quantile_cont(m3, [0.95, 0.97, 0.99, 0.995])) AS tau FROM sc WHERE vec_id % 2 = 0) SELECT p::DOUBLE AS p, round(tau, 4) AS tau, (SELECT count(*) FROM sc WHERE m3 > tau) AS n_alerts FROM t")
def _(spark, sf):
    e = errors(spark, sf)
    s = detection.window_scores(e, detection.calibrate(e.where("vec_id % 2 = 0")), "vec_id")
    per = s.groupBy("m3").agg(F.count_if(F.col("vec_id") % 2 == 0).alias("half"), F.count("*").alias("all"))
    taus = grid_quantiles(per, "m3", "half", 1000).where("k in (950, 970, 990, 995)").select((F.col("k") / 10).alias("p"), "tau")
    n = F.sum(F.when(F.col("m3") > F.col("tau"), F.col("all")).otherwise(0))
    return per.join(F.broadcast(taus)).groupBy("p", "tau").agg(n.alias("n_alerts")).select("p", F.round("tau", 4).alias("tau"), "n_alerts")


def draw_sql(rounds: int, seed: int, block: int = 1) -> str:
    """The draws of ``classify.draws`` for a table n (n), as ix (b, i, at)."""
    start = f"(('0x' || substr(md5('{seed}-' || b || '-' || (i // {block})), 1, 15))::BIGINT % greatest(n - {block - 1}, 1))"
    return f"ix AS (SELECT b, i, {start} + i % {block} AS at FROM n, unnest(range(1, {rounds + 1})) u(b), unnest(range(0, n)) v(i))"


@query("bootstrap_ci", P + ", o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at, max(CASE WHEN seed = 0 AND label = pred THEN 1 ELSE 0 END) - max(CASE WHEN seed = 1 AND label = pred THEN 1 ELSE 0 END) AS d FROM pred GROUP BY vec_id), n AS (SELECT count(*) AS n FROM o), " + draw_sql(1000, 7919) + ", s AS (SELECT b, avg(d) AS m FROM ix JOIN o ON ix.at = o.at GROUP BY b) SELECT count(*) AS rounds, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END), 6) AS equal, round(avg(CASE WHEN m < 0 THEN 1.0 ELSE 0.0 END), 6) AS below FROM s")
def _(spark, sf):
    """Paired bootstrap of the difference of two models' accuracy, 1,000 rounds: the 95 % interval and the shares of rounds above, at and below 0."""
    ok = lambda s: F.max(F.when((F.col("seed") == s) & (F.col("label") == F.col("pred")), 1).otherwise(0))
    o = preds(spark, sf).groupBy("vec_id").agg((ok(0) - ok(1)).alias("d"))

    def plain():
        return classify.draws(o.agg(F.count("vec_id").alias("n")), 1000, 7919).join(classify.numbered(o, "vec_id").hint("merge"), "at").groupBy("b").agg(F.avg("d").alias("m"))

    s = resample.by_round(o, "vec_id", 1000, 7919, 1, resample.mean, "m double", plain).where("b > 0")
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return s.agg(F.count("*").alias("rounds"), F.round(q[0], 6).alias("lo"), F.round(q[1], 6).alias("hi"), share(F.col("m") > 0, "above"), share(F.col("m") == 0, "equal"), share(F.col("m") < 0, "below"))


@query("block_bootstrap", T + ", o AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, avg(v) AS x FROM tm GROUP BY vec_id), n AS (SELECT count(*) AS n FROM o), " + draw_sql(1000, 7919, 7) + ", q AS (SELECT b, quantile_cont(x, 0.95) AS p95 FROM ix JOIN o ON ix.at = o.at GROUP BY b) SELECT round((SELECT quantile_cont(x, 0.95) FROM o), 6) AS full_sample, count(*) AS rounds, round(avg(p95), 6) AS boot_mean, round(stddev_samp(p95), 6) AS boot_sd, round(quantile_cont(p95, 0.025), 6) AS ci_low, round(quantile_cont(p95, 0.975), 6) AS ci_high FROM q")
def _(spark, sf):
    """Moving-block bootstrap of a percentile, blocks of seven, 1,000 rounds."""
    x = table(spark, sf, "embeddings").select("vec_id", F.explode_outer("embedding").alias("v"))
    o = x.groupBy("vec_id").agg(F.avg(F.col("v").cast("double")).alias("x"))

    def plain():
        p95 = F.percentile("x", F.lit(0.95)).alias("p95")
        at = classify.numbered(o, "vec_id").hint("merge")
        return o.agg(F.lit(0).cast("long").alias("b"), p95).union(classify.draws(o.agg(F.count("vec_id").alias("n")), 1000, 7919, 7).join(at, "at").groupBy("b").agg(p95))

    r = resample.by_round(o, "vec_id", 1000, 7919, 7, resample.percentile_of(0.95), "p95 double", plain)
    x = F.when(F.col("b") > 0, F.col("p95"))
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(F.round(F.max(F.when(F.col("b") == 0, F.col("p95"))), 6).alias("full_sample"), F.count_if(F.col("b") > 0).alias("rounds"), F.round(F.avg(x), 6).alias("boot_mean"), F.round(F.stddev_samp(x), 6).alias("boot_sd"), F.round(q[0], 6).alias("ci_low"), F.round(q[1], 6).alias("ci_high"))


RECAL = ERR + ", w AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM (SELECT DISTINCT vec_id FROM e)), n AS (SELECT count(*) AS n FROM w), " + draw_sql(1000, 31, 7) + (
    ", r0 AS (SELECT 0 AS b, w.at AS i, node, error, valid FROM e JOIN w USING (vec_id) UNION ALL SELECT ix.b, ix.i, e.node, e.error, e.valid FROM ix JOIN w ON w.at = ix.at JOIN e USING (vec_id))"
    ", q AS (SELECT b, node, quantile_cont(error, 0.5) AS md, quantile_cont(error, 0.75) - quantile_cont(error, 0.25) AS iqr FROM r0 WHERE valid GROUP BY b, node), ep AS (SELECT b, greatest(1e-6, 0.01 * median(iqr)) AS eps FROM q GROUP BY b)"
    ", z AS (SELECT r0.b, r0.i, CASE WHEN valid THEN error END AS e, CASE WHEN valid THEN (error - md) / greatest(iqr, eps) END AS z FROM r0 JOIN q ON r0.b = q.b AND r0.node = q.node JOIN ep ON ep.b = r0.b)"
    ", k AS (SELECT *, row_number() OVER (PARTITION BY b, i ORDER BY z DESC NULLS LAST) AS rk FROM z), m AS (SELECT b, i, coalesce(max(e), '-Infinity'::DOUBLE) AS m1, coalesce(max(z), '-Infinity'::DOUBLE) AS m2, coalesce(avg(z) FILTER (WHERE rk <= 3), '-Infinity'::DOUBLE) AS m3 FROM k GROUP BY b, i)"
    ", t AS (SELECT b, unnest(['m1', 'm2', 'm3']) AS method, unnest([quantile_cont(m1, 0.99), quantile_cont(m2, 0.99), quantile_cont(m3, 0.99)]) AS tau FROM m GROUP BY b)"
    " SELECT method, round(max(tau) FILTER (WHERE b = 0), 4) AS full_sample, count(*) FILTER (WHERE b > 0) AS rounds, round(avg(tau) FILTER (WHERE b > 0), 4) AS boot_mean, round(stddev_samp(tau) FILTER (WHERE b > 0), 4) AS boot_sd, round(quantile_cont(tau, 0.025) FILTER (WHERE b > 0), 4) AS ci_low, round(quantile_cont(tau, 0.975) FILTER (WHERE b > 0), 4) AS ci_high FROM t GROUP BY method"
)


@query("recalibrated_bootstrap", RECAL)
def _(spark, sf):
    """Moving-block bootstrap of the alert thresholds, each round calibrated anew: statistics, scores and thresholds. Round 0 is the sample itself."""
    e = errors(spark, sf)
    ids = table(spark, sf, "embeddings").select("vec_id").distinct()

    def plain():
        w = classify.numbered(ids, "vec_id")
        ix = classify.draws(w.agg(F.count("*").alias("n")), 1000, 31, 7)
        ix = w.select(F.lit(0).cast("long").alias("b"), F.col("at").alias("i"), "at").union(ix.select("b", "i", "at"))
        r = ix.join(w.hint("merge"), "at").join(e.hint("merge"), "vec_id").select("b", "i", "node", "error", "valid")
        m = detection.window_scores(r.hint("merge"), detection.calibrate(r, keys=("b",)), "i", keys=("b",))
        return m.groupBy("b").agg(*(F.percentile(c, F.lit(0.99)).alias(c) for c in ("m1", "m2", "m3")))

    per = e.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("node", F.when(F.col("valid"), F.col("error")).alias("error")))).alias("s"))
    rows = ids.join(per, "vec_id", "left").select("vec_id", F.col("s.node").alias("nodes"), F.col("s.error").alias("errors"))
    t = resample.by_round(rows, "vec_id", 1000, 31, 7, resample.thresholds(), "m1 double, m2 double, m3 double", plain, cells=8).unpivot("b", ["m1", "m2", "m3"], "method", "tau")
    x = F.when(F.col("b") > 0, F.col("tau"))
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return t.groupBy("method").agg(r4(F.max(F.when(F.col("b") == 0, F.col("tau"))), "full_sample"), F.count(x).alias("rounds"), r4(F.avg(x), "boot_mean"), r4(F.stddev_samp(x), "boot_sd"), r4(q[0], "ci_low"), r4(q[1], "ci_high"))


@query("block_zscore", T + ", b AS (SELECT vec_id // 180 AS block, dim, avg(v) AS m, stddev_pop(v) AS s FROM tm GROUP BY 1, 2) SELECT block, count(*) FILTER (WHERE s = 0) AS constant, count(*) FILTER (WHERE s > 0 AND abs(m) < 0.01 AND abs(s - 0.12) < 0.01) AS standard, count(*) AS n FROM b GROUP BY block")
def _(spark, sf):
    b = ten(spark, sf).groupBy(F.floor(F.col("vec_id") / 180).alias("block"), "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return b.groupBy("block").agg(F.count_if(F.col("s") == 0).alias("constant"), F.count_if((F.col("s") > 0) & (F.abs("m") < 0.01) & (F.abs(F.col("s") - 0.12) < 0.01)).alias("standard"), F.count("*").alias("n"))


@query("unpivot_repivot", T + " SELECT vec_id, count(*) AS n, round(sum(CASE WHEN dim = 0 THEN v END), 6) AS d0, round(sum(CASE WHEN dim = 17 THEN v END), 6) AS d17, round(sum(CASE WHEN dim = 63 THEN v END), 6) AS d63 FROM tm GROUP BY vec_id HAVING count(*) = 64")
def _(spark, sf):
    wide = ten(spark, sf).groupBy("vec_id").pivot("dim", list(range(64))).agg(F.first("v"))
    n = ten(spark, sf).groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 64")
    return wide.join(n, "vec_id").select("vec_id", "n", *(F.round(F.col(str(k)), 6).alias(f"d{k}") for k in (0, 17, 63)))


@query("modality_subsets", T + ", m AS (SELECT unnest(range(1, 8)) AS mask), b AS (SELECT 'metric' AS modality, 0 AS bit UNION ALL SELECT 'trace', 1 UNION ALL SELECT 'log', 2) SELECT m.mask, count(*) AS n, round(avg(v * v), 6) AS energy FROM m JOIN b ON ((m.mask >> b.bit) & 1) = 1 JOIN tm ON tm.modality = b.modality GROUP BY m.mask")
def _(spark, sf):
    bit = F.when(F.col("modality") == "metric", 0).when(F.col("modality") == "trace", 1).otherwise(2)
    per = ten(spark, sf).groupBy(bit.alias("bit")).agg(F.count("*").alias("c"), F.sum(F.col("v") * F.col("v")).alias("s"))
    masks = spark.range(1, 8).withColumnRenamed("id", "mask")
    j = masks.join(per, F.expr("(shiftright(mask, bit) & 1) = 1"))
    return j.groupBy("mask").agg(F.sum("c").alias("n"), F.round(F.sum("s") / F.sum("c"), 6).alias("energy"))


@query("scoring_rules", T + ", d AS (SELECT vec_id, dim, v * v AS e FROM tm) SELECT vec_id, round(avg(e), 8) AS s1, round(sum(CASE WHEN dim = 63 THEN e END), 8) AS s2, round(avg(CASE WHEN dim >= 59 THEN e END), 8) AS s3 FROM d GROUP BY vec_id")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("e"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return e.select("vec_id", F.round(mean(F.col("e")), 8).alias("s1"), F.round(F.element_at("e", -1), 8).alias("s2"), F.round(mean(F.slice("e", -5, 5)), 8).alias("s3"))
