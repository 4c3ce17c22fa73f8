"""Queries that check a split of windows, cases and folds against its protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import checks, detection, freeze, intervals, profile
from pulsegrid.operators import warehouse as wh
from pulsegrid.session import scratch
from pulsegrid.sources import archives, files

from .check_queries import BOUNDARY, EMBARGO
from .registry import query, sql_of
from .views import CASES, TEL, cases, grid, table, tel

TEST = 1705536000
ROLE = f"CASE WHEN target < {BOUNDARY - EMBARGO} THEN 'fit' WHEN start >= {BOUNDARY} AND target < {TEST} THEN 'calibration' WHEN start >= {TEST} THEN 'test' WHEN target < {TEST} THEN 'embargo' ELSE 'crossing' END"
WINDOWS = "WITH " + CASES + f", wc AS ({sql_of('window_categories')}), w AS (SELECT wc.*, {ROLE} AS role, coalesce(cs.class, -1) AS fault, CASE WHEN category = 'event_associated' AND ambiguous THEN 'ambiguous' END AS reason FROM wc LEFT JOIN cs ON cs.case_id = wc.case_id)"
GROUPED = WINDOWS + (
    f", ep AS ({sql_of('incident_groups')}), cg AS (SELECT cs.case_id, cs.t, ep.start_t AS grp FROM cs JOIN ep ON cs.t - 900 BETWEEN ep.start_t AND ep.end_t)"
    ", ew AS (SELECT DISTINCT case_id, role FROM w WHERE category = 'event_associated' AND case_id IS NOT NULL AND role IN ('fit', 'calibration'))"
    ", cr AS (SELECT cg.case_id, cg.t, cg.grp, coalesce(bool_or(ew.role = 'fit'), false) AS f, coalesce(bool_or(ew.role = 'calibration'), false) AS c FROM cg LEFT JOIN ew ON ew.case_id = cg.case_id GROUP BY ALL)"
)


def labelled(spark, sf):
    """Windows with their role, fault class (-1 without one) and the reason why an event window has none."""
    c = cases(spark, sf)
    w = detection.window_categories(intervals.windows(grid(spark, sf), 7, 600), c, match=(59, 300), guard=(179, 600))
    w = w.join(c.select("case_id", F.col("class").alias("fault")), "case_id", "left").withColumn("fault", F.coalesce("fault", F.lit(-1)))
    reason = F.when((F.col("category") == "event_associated") & F.col("ambiguous"), "ambiguous")
    return w.withColumn("role", F.expr(ROLE)).withColumn("reason", reason)


def grouped_cases(spark, sf):
    """(case_id, t, grp): cases with the start of their incident group."""
    c = cases(spark, sf).select("case_id", "t", (F.col("t") - 900).alias("lo"), (F.col("t") + 900).alias("hi"))
    groups = intervals.episodes(c, "lo", "hi").select(F.col("start_t").alias("grp"), "end_t")
    return intervals.bucket_join(c.select("case_id", "t", "lo"), groups, "lo", "grp", "end_t", 3600).select("case_id", "t", "grp")


@query("split_leakage", GROUPED + (
    ", m AS (SELECT m, bool_or(role = 'fit') AS f, bool_or(role = 'calibration') AS c FROM (SELECT role, unnest(range(start, target + 1, 600)) AS m FROM w) GROUP BY m), gr AS (SELECT grp, bool_or(f) AS f, bool_or(c) AS c FROM cr GROUP BY grp)"
    f", cut AS (SELECT (SELECT arg_max(grp, (t, case_id)) FROM cr WHERE t < {BOUNDARY}) AS a, (SELECT arg_min(grp, (t, case_id)) FROM cr WHERE t >= {BOUNDARY} AND t < {TEST}) AS b)"
    ", k AS (SELECT 'l1_shared_moment' AS \"check\", count(*) FILTER (WHERE f AND c) AS violations FROM m UNION ALL SELECT 'l2_case_on_both_sides', count(*) FILTER (WHERE f AND c) FROM cr UNION ALL SELECT 'l3_group_on_both_sides', count(*) FILTER (WHERE f AND c) FROM gr"
    f" UNION ALL SELECT 'l4_train_case_not_on_one_side', count(*) FILTER (WHERE t < {TEST} AND f = c) FROM cr UNION ALL SELECT 'l5_window_leaves_its_region', count(*) FILTER (WHERE (role = 'fit' AND target >= {BOUNDARY - EMBARGO}) OR (role = 'calibration' AND (start < {BOUNDARY} OR target >= {TEST}))) FROM w"
    f" UNION ALL SELECT 'l6_role_outside_its_period', count(*) FILTER (WHERE (role IN ('fit', 'calibration') AND target >= {TEST}) OR (role = 'test' AND start < {TEST})) FROM w UNION ALL SELECT 'l7_cut_inside_a_group', CASE WHEN a <> b THEN 0 ELSE 1 END FROM cut"
    f" UNION ALL SELECT 'l8_stray_embargo', count(*) FILTER (WHERE role = 'embargo' AND NOT (target >= {BOUNDARY - EMBARGO} AND start < {BOUNDARY})) FROM w UNION ALL SELECT 'l9_unexplained_event_window', count(*) FILTER (WHERE category = 'event_associated' AND fault = -1 AND reason IS NULL) FROM w"
    " UNION ALL SELECT 'l10_inconsistent_reason', count(*) FILTER (WHERE reason IS NOT NULL AND NOT (fault = -1 AND category = 'event_associated')) FROM w)"
    " SELECT \"check\", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM k"
))
def _(spark, sf):
    return checks.split_leakage(labelled(spark, sf), grouped_cases(spark, sf), BOUNDARY, EMBARGO, TEST, 600)


TIMING = WINDOWS + ", e AS (SELECT DISTINCT case_id, unnest(range(start, target + 1, 600)) AS m FROM w WHERE category = 'event_associated' AND case_id IS NOT NULL), tm AS (SELECT e.case_id, min(m) AS first_sample, max(m) AS last_sample, count(*) AS n_samples, min(m) - any_value(cs.t) AS first_offset, max(m) - any_value(cs.t) AS last_offset, count(*) FILTER (WHERE m < cs.t) AS n_before, count(*) FILTER (WHERE m >= cs.t) AS n_after FROM e JOIN cs ON cs.case_id = e.case_id GROUP BY e.case_id)"


def timing(spark, sf):
    w = labelled(spark, sf).where("category = 'event_associated' and case_id is not null")
    e = w.select("case_id", F.explode(F.sequence("start", "target", F.lit(600).cast("long"))).alias("m")).distinct().join(cases(spark, sf).select("case_id", "t"), "case_id")
    return e.groupBy("case_id").agg(F.min("m").alias("first_sample"), F.max("m").alias("last_sample"), F.count("*").alias("n_samples"), (F.min("m") - F.min("t")).alias("first_offset"), (F.max("m") - F.min("t")).alias("last_offset"), F.count_if(F.col("m") < F.col("t")).alias("n_before"), F.count_if(F.col("m") >= F.col("t")).alias("n_after"))


@query("case_timing", TIMING + " SELECT * FROM tm")
def _(spark, sf):
    """The samples behind each case: first and last, offsets from the case's time, how many before and after it."""
    return timing(spark, sf)


@query("case_alignment", TIMING + ", fr AS (SELECT case_id, first_sample, last_sample, n_samples + CASE WHEN case_id % 11 = 0 THEN 1 ELSE 0 END AS n_samples FROM tm WHERE case_id % 7 <> 0), nw AS (SELECT * FROM tm WHERE case_id % 13 <> 0), j AS (SELECT nw.case_id AS a, fr.case_id AS b, nw.first_sample = fr.first_sample AND nw.last_sample = fr.last_sample AND nw.n_samples = fr.n_samples AS same FROM nw FULL JOIN fr ON nw.case_id = fr.case_id) SELECT CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'unexpected' WHEN same THEN 'ok' ELSE 'differs' END AS status, count(*) AS n FROM j GROUP BY 1")
def _(spark, sf):
    """Cases and their samples against a frozen list of them."""
    now = timing(spark, sf)
    kept = ["case_id", "first_sample", "last_sample", "n_samples"]
    frozen = now.where("case_id % 7 <> 0").withColumn("n_samples", F.col("n_samples") + F.when(F.col("case_id") % 11 == 0, 1).otherwise(0))
    pack = lambda d: d.select(*kept).select("case_id", F.concat_ws("-", *(F.col(c).cast("string") for c in kept[1:])).alias("n"))
    return checks.against(pack(now.where("case_id % 13 <> 0")), pack(frozen), ["case_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("cv_roles", WINDOWS + f", f AS (SELECT unnest(range(5)) AS fold) SELECT fold, CASE WHEN target // 86400 % 5 = fold THEN 'validation' ELSE 'fit' END AS role, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM w, f WHERE target < {TEST} GROUP BY ALL")
def _(spark, sf):
    """Folds of whole days: the held-out days are validation, the others fit; a window of the test period in a fold would be an error."""
    w = wh.require(labelled(spark, sf).where(F.col("target") < TEST), (F.col("target") < TEST) & (F.col("role") != "test"), "a test window in a fold")
    w = w.select("target", "case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold"))
    role = F.when(F.floor(F.col("target") / 86400) % 5 == F.col("fold"), "validation").otherwise("fit")
    return w.groupBy("fold", role.alias("role")).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("n_cases"))


@query("training_rows", WINDOWS + " SELECT start, target FROM w WHERE role = 'fit' AND category = 'normal_reference'")
def _(spark, sf):
    """What training may read: normal windows of the fit role. One that reaches the embargo would be an error, not a row."""
    w = labelled(spark, sf).where("role = 'fit' and category = 'normal_reference'")
    return wh.require(w, F.col("target") < BOUNDARY - EMBARGO, "a training window reaches the embargo").select("start", "target")


SPLIT = "CASE WHEN user_id % 5 < 3 THEN 'train' WHEN user_id % 5 = 3 THEN 'validation' ELSE 'test' END"


@query("protocol_checks", "WITH " + TEL + f", s AS (SELECT *, {SPLIT} AS split FROM tel), u AS (SELECT user_id, count(DISTINCT split) AS k FROM s GROUP BY user_id), f AS (SELECT split, count(DISTINCT channel) AS k FROM s GROUP BY split), sc AS (SELECT channel, avg(value) FILTER (WHERE split = 'train') AS a, avg(value) AS b FROM s GROUP BY channel), n AS (SELECT split, channel, count(*) AS n FROM s GROUP BY ALL), sh AS (SELECT split, channel, n / sum(n) OVER (PARTITION BY split) AS share, sum(n) OVER (PARTITION BY channel) / sum(n) OVER () AS whole FROM n) SELECT 'split_overlap' AS \"check\", count(*) FILTER (WHERE k > 1) AS violations FROM u UNION ALL SELECT 'feature_missing', (5 * 3 - sum(k))::BIGINT FROM f UNION ALL SELECT 'scaler_of_all_rows_differs', count(*) FILTER (WHERE abs(a - b) > 1e-9) FROM sc UNION ALL SELECT 'share_off_by_a_fifth', count(*) FILTER (WHERE abs(share - whole) > 0.2) FROM sh")
def _(spark, sf):
    """Checks of a split by entity: entities in two parts, features that a part lacks, whether a scaler of all rows would show, and parts whose shares of a channel are off."""
    s = tel(spark, sf).withColumn("split", F.expr(SPLIT))
    overlap = checks.rows_of(s.groupBy("user_id").agg(F.count_distinct("split").alias("k")), split_overlap=F.count_if(F.col("k") > 1))
    n = s.groupBy("split", "channel").agg(F.count("*").alias("n"))
    missing = checks.rows_of(n, feature_missing=15 - F.count("*"))
    scaler = profile.fit_scaler(s.where("split = 'train'"), ["channel"], "value").join(profile.fit_scaler(s, ["channel"], "value").select("channel", F.col("mean").alias("other")), "channel")
    differs = checks.rows_of(scaler, scaler_of_all_rows_differs=F.count_if(F.abs(F.col("mean") - F.col("other")) > 1e-9))
    by = n.join(n.groupBy("split").agg(F.sum("n").alias("of_split")), "split").join(n.groupBy("channel").agg(F.sum("n").alias("of_channel")), "channel").crossJoin(F.broadcast(n.agg(F.sum("n").alias("whole"))))
    off = F.abs(F.col("n") / F.col("of_split") - F.col("of_channel") / F.col("whole")) > 0.2
    return overlap.union(missing).union(differs).union(checks.rows_of(by, share_off_by_a_fifth=F.count_if(off)))


@query("empty_mask_period", "WITH " + TEL + f", p AS (SELECT CASE WHEN t < {BOUNDARY} THEN 'before' WHEN t < {TEST} THEN 'middle' ELSE 'after' END AS period, count(*) AS n FROM tel GROUP BY 1) SELECT k.period, coalesce(p.n, 0) AS n, CASE WHEN coalesce(p.n, 0) = 0 THEN 'error' ELSE 'ok' END AS status FROM (SELECT unnest(['before', 'middle', 'after', 'never']) AS period) k LEFT JOIN p ON p.period = k.period")
def _(spark, sf):
    """Each period that a mask is checked in, and whether it has rows at all: an empty one is an error, not a pass."""
    period = F.when(F.col("t") < BOUNDARY, "before").when(F.col("t") < TEST, "middle").otherwise("after")
    n = tel(spark, sf).groupBy(period.alias("period")).agg(F.count("*").alias("n"))
    k = spark.createDataFrame([(x,) for x in ("before", "middle", "after", "never")], "period string").join(n, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return k.withColumn("status", F.when(F.col("n") == 0, "error").otherwise("ok"))


@query("archive_members", "WITH m AS (SELECT r_name, n_name || '.txt' AS member, 'ok' AS status, length(n_name)::BIGINT AS size FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, unnest(['../up.txt', '/root.txt', 'a/../../b.txt', 'link', '__MACOSX/x', 'dir/']), unnest(['unsafe_path', 'unsafe_path', 'unsafe_path', 'symlink', 'skipped', 'directory']), unnest([1, 1, 1, 1, 1, 0])::BIGINT FROM region) SELECT * FROM m")
def _(spark, sf):
    """What zip archives hold, and what of it may be extracted; archives are written by executors and never touch a disk when they are read."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    packed = j.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    root = scratch(spark, "zips")
    archives.write_archives(packed, "r_name", "names", root)
    members = archives.read_archives(spark, root)
    return members.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("r_name"), "member", "status", "size").withColumn("r_name", F.regexp_replace("r_name", "%20", " "))


@query("test_lock", "WITH r AS (SELECT CASE WHEN event_id % 10 < 7 THEN 'fit' WHEN event_id % 10 = 7 THEN 'calibration' WHEN event_id % 10 = 8 THEN 'validation' ELSE 'test' END AS role FROM events), c AS (SELECT role, count(*) AS n FROM r GROUP BY role) SELECT step, role, n FROM c, (SELECT unnest(['locked', 'claimed', 'refused']) AS step) WHERE (step = 'claimed' AND role <> 'fit') OR (step <> 'claimed' AND role IN ('calibration', 'validation'))")
def _(spark, sf):
    """What may be scored before the one test run is claimed, with its token, and after a second claim was refused."""
    root, id_ = scratch(spark, "freeze"), F.col("event_id") % 10
    for name in ("region", "nation"):
        table(spark, sf, name).write.parquet(f"{root}/work/{name}")
    found = files.inventory(spark, f"{root}/work")
    freeze.freeze(found, f"{root}/record")
    e = table(spark, sf, "events").select(F.when(id_ < 7, "fit").when(id_ == 7, "calibration").when(id_ == 8, "validation").otherwise("test").alias("role"))
    counted = lambda step, token: freeze.scorable(e, "role", token).groupBy(F.lit(step).alias("step"), "role").agg(F.count("*").alias("n"))
    markers = [f"{root}/marker-{k}.json" for k in range(2)]
    locked, claimed, second = counted("locked", None), counted("claimed", freeze.claim(found, f"{root}/record", markers)), None
    try:
        second = freeze.claim(found, f"{root}/record", markers)
    except freeze.FreezeError:
        pass
    return locked.union(claimed).union(counted("refused", second))
