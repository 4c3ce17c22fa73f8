"""Bootstraps by round against their draws, and the plans they run by."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import classify, detection, resample
from pulsegrid.plans import registry


def test_multiplicities_are_those_of_the_draws(spark):
    for n, block in ((1, 1), (5, 7), (23, 7), (49, 7), (1000, 1)):
        got = classify.draws(spark.range(1).select(F.lit(n).alias("n")), 4, 31, block).collect()
        for b in range(1, 5):
            assert resample.multiplicities(n, 31, b, block).tolist() == np.bincount([r["at"] for r in got if r.b == b], minlength=n).tolist()
    assert resample.multiplicities(0, 31, 1, 7).tolist() == []


def test_percentiles_interpolate_and_skip_what_is_not_drawn():
    x, n = np.array([5.0, 1.0, 9.0, np.inf]), np.array([2, 1, 1, 0])
    order = np.argsort(x)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        want = float(np.quantile([1.0, 5.0, 5.0, 9.0], q))
        assert resample.percentile(x, n, q) == pytest.approx(want) == resample.sorted_percentiles(x[order], n[order], (q,))[0]
    assert resample.percentile(x, n * 0, 0.5) is None and resample.sorted_percentiles(x, n * 0, (0.5,)) is None


def same_and_unjoined(spark, sf, name, monkeypatch):
    """The query has no row for a draw, so nothing is joined, and its rows are those of the plan beyond the bound, which broadcasts no draws."""
    df = registry.queries()[name](spark, sf)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(resample, "MOST", 0)
    df = registry.queries()[name](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [at#" in text and "BroadcastHashJoin [at#" not in text
    assert sorted(map(tuple, df.collect())) == got


def test_block_bootstrap_makes_no_row_for_a_draw(spark, small, monkeypatch):
    same_and_unjoined(spark, small, "block_bootstrap", monkeypatch)


def test_block_bootstrap_counts_rows_without_numbers(spark, tmp_path):
    rows = [(k, k % 10, [float(k % 7), float(k)] if k % 5 else None) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    r = registry.queries()["block_bootstrap"](spark, str(tmp_path)).first()
    x = np.array([np.nan if e is None else sum(e) / 2 for _, _, e in rows])
    each = [np.nanquantile(np.repeat(x, resample.multiplicities(40, 7919, b, 7)), 0.95) for b in range(1001)]
    assert r.rounds == 1000 and r.full_sample == round(each[0], 6) and r.boot_mean == pytest.approx(np.mean(each[1:]), abs=1e-6)
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(each[1:], (0.025, 0.975))), abs=1e-6)


def test_bootstrap_ci_makes_no_row_for_a_draw(spark, small, monkeypatch):
    same_and_unjoined(spark, small, "bootstrap_ci", monkeypatch)


def test_recalibrated_bootstrap_makes_no_row_for_a_draw(spark, small, monkeypatch):
    df = registry.queries()["recalibrated_bootstrap"](spark, small)
    assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, df.collect()))
    assert len(got) == 3 and all(r[2] == 1000 for r in got)


def test_thresholds_are_those_of_the_scored_draws(spark):
    rng = np.random.default_rng(3)
    rows = [(k, m, float(rng.integers(0, 9)) if m else 1.0, bool((k + m) % 4)) for k in range(30) for m in range(5) if k not in (4, 17) and (m < 4 or k < 2)] + [(30, 0, 0.0, False), (31, 4, 0.0, False)]
    e = spark.createDataFrame(rows, "at long, node long, error double, valid boolean")
    per = e.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("node", F.when(F.col("valid"), F.col("error")).alias("error")))).alias("s"))
    ids = spark.range(32).select(F.col("id").alias("at")).join(per, "at", "left").select("at", F.col("s.node").alias("nodes"), F.col("s.error").alias("errors"))
    n = spark.range(1).select(F.lit(32).alias("n"))

    def plain():
        ix = classify.draws(n, 20, 31, 7).union(spark.range(32).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("i"), F.col("id").alias("at")))
        r = ix.join(e, "at").select("b", "i", "node", "error", "valid")
        m = detection.window_scores(r, detection.calibrate(r, keys=("b",)), "i", keys=("b",))
        return m.groupBy("b").agg(*(F.percentile(c, F.lit(0.99)).alias(c) for c in ("m1", "m2", "m3")))

    got = resample.by_round(ids, "at", 20, 31, 7, resample.thresholds(), "m1 double, m2 double, m3 double", plain, cells=8)
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(map(tuple, plain().collect())), strict=True):
        assert a == pytest.approx(b, rel=1e-12)
