"""Boundaries of the time operators, and random tables against plain loops."""

import random

import pytest

from pulsegrid.operators import detection
from pulsegrid.operators import intervals as iv


def frame(spark, ts):
    return spark.createDataFrame([(t,) for t in ts], "t long").repartition(3)


def pairs(df):
    return sorted((r.start_t, r.end_t) for r in df.select("start_t", "end_t").collect())


@pytest.mark.parametrize(("gap", "want"), [(599, [(0, 779)]), (600, [(0, 60), (660, 720)]), (601, [(0, 60), (661, 721)])])
def test_alerts_split_at_the_gap(spark, gap, want):
    ts = [0, 60, 60 + gap, 120 + gap]
    assert pairs(iv.alert_intervals(frame(spark, ts))) == ([(0, 120 + gap)] if gap < 600 else [(0, 60), (60 + gap, 120 + gap)])


def test_lone_and_repeated_alerts_are_dropped(spark):
    assert pairs(iv.alert_intervals(frame(spark, [5]))) == []
    assert pairs(iv.alert_intervals(frame(spark, [5, 5, 5]))) == []
    assert pairs(iv.alert_intervals(frame(spark, []))) == []


def test_islands_cross_shards(spark):
    ts = [86_390, 86_400, 86_410, 3 * 86_400]
    got = sorted((r.start_t, r.end_t, r.n) for r in iv.island_spans(frame(spark, ts), lambda g: g > 60).collect())
    assert got == [(86_390, 86_410, 3), (259_200, 259_200, 1)]


@pytest.mark.parametrize("breaks", [lambda g: g > 60, lambda g: g >= 600, lambda g: g != 60])
def test_island_spans_against_loops(spark, breaks):
    random_, rows = random.Random(8), []
    for key in "ab":
        t = 0
        for _ in range(400):
            t += random_.choice([0, 30, 60, 60, 60, 599, 600, 1800, 9000])
            rows.append((key, t))
    want = []
    for key in "ab":
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or breaks(t - last):
                want.append([key, t, t, 0])
            want[-1][2:] = [t, want[-1][3] + 1]
            last = t
    df = spark.createDataFrame(rows, "k string, t long").repartition(5)
    for shard in (90, 3600):
        got = iv.island_spans(df, breaks, keys=["k"], shard=shard).collect()
        assert sorted([r.k, r.start_t, r.end_t, r.n] for r in got) == sorted(want)
    assert iv.island_spans(df.limit(0), breaks).count() == 0


def test_event_metrics_edges(spark):
    i = spark.createDataFrame([(1000, 1060)], "start_t long, end_t long")
    for t, hit in ((1360, 1), (1361, 0), (700, 1), (699, 0)):
        r = detection.event_metrics(i, frame(spark, [t, t])).first()
        assert (r.tp, r.n_labels, r.fp, r.scored) == (hit, 1, 1 - hit, bool(hit))
    r = detection.event_metrics(i, frame(spark, [900, 1000, 1100])).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (3, 0, 0, 1.0)
    i = spark.createDataFrame([(1000, 1060), (5000, 5060), (9000, 9060)], "start_t long, end_t long")
    r = detection.event_metrics(i, frame(spark, [900, 1000, 1100, 1100, 5300, 20_000])).first()
    assert (r.n_intervals, r.n_labels, r.tp, r.fp, r.fn, r.density) == (3, 5, 4, 1, 1, 2.0)
    r = detection.event_metrics(i.limit(0), frame(spark, [])).first()
    assert (r.precision, r.recall, r.f1, r.scored) == (0.0, 0.0, 0.0, False)


def test_nearest_prefers_the_earlier_and_closes_the_tolerance(spark):
    left = spark.createDataFrame([(1, 100), (2, 200), (3, 500)], "_id long, t long")
    right = spark.createDataFrame([(90,), (110,), (230,)], "r long")
    assert {r._id: r.near for r in iv.nearest(left, right, "t", "r", 30).collect()} == {1: 90, 2: 230, 3: None}
    assert {r._id: r.near for r in iv.nearest_any(left, right, "t", "r").collect()} == {1: 90, 2: 230, 3: 230}


def test_windows_never_bridge_a_gap(spark):
    random_ = random.Random(4)
    ts, t = [], 0
    for _ in range(300):
        t += random_.choice([60, 60, 60, 60, 120, 30])
        ts.append(t)
    want = sorted((ts[k], ts[k + 6]) for k in range(len(ts) - 6) if all(ts[j + 1] - ts[j] == 60 for j in range(k, k + 6)))
    assert sorted((r.start, r.target) for r in iv.windows(frame(spark, ts), 7, 60).collect()) == want


def test_episodes_and_running_values_against_loops(spark):
    random_ = random.Random(6)
    spans = [(s, s + random_.randrange(9000)) for s in random_.sample(range(900_000), 150)] + [(0, 200_000)]
    want, end = [], None
    for lo, hi in sorted(spans):
        if end is None or lo > end:
            want.append([lo, hi])
            end = hi
        end = max(end, hi)
        want[-1][1] = end
    assert pairs(iv.episodes(spark.createDataFrame(spans, "lo long, hi long"), "lo", "hi")) == [tuple(w) for w in want]


def test_rolling_max_has_both_ends(spark):
    rows = [(0, 5.0), (60, 1.0), (120, 2.0), (86_399, 9.0), (86_459, 1.0), (86_460, 0.0)]
    got = {r.t: r.rolled for r in iv.rolling_max(spark.createDataFrame(rows, "t long, s double"), "s", 60).collect()}
    assert got == {0: 5.0, 60: 5.0, 120: 2.0, 86_399: 9.0, 86_459: 9.0, 86_460: 1.0}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_bucket_join_is_the_theta_join(spark, how):
    random_ = random.Random(2)
    points = spark.createDataFrame([(k, random_.randrange(5000)) for k in range(200)], "k long, t long")
    spans = spark.createDataFrame([(k, x, x + random_.randrange(400)) for k, x in enumerate(random_.sample(range(5000), 30))], "s long, lo long, hi long")
    want = points.join(spans, (points.t >= spans.lo) & (points.t <= spans.hi), how)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect())))
    got = iv.bucket_join(points, spans, "t", "lo", "hi", 100, how)
    assert key(got) == key(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
