"""Evaluation, profiles, sources, streaming and the driver's entry."""

import math
import os
import pickle
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import maths, models
from pulsegrid.operators import classify, detection, profile, warehouse
from pulsegrid.sources import files
from pulsegrid.streaming import minutes


def test_ties_and_empty_denominators(spark):
    df = spark.createDataFrame([([0.3, 0.3, 0.1],), ([0.1, 0.2, 0.2],)], "p array<double>")
    assert [r[0] for r in df.select(maths.argmax(F.col("p"))).collect()] == [0, 1]
    r = spark.range(1).select(maths.div0(F.lit(1), F.lit(0)), maths.div_nan(F.lit(1), F.lit(0)), maths.half_even(F.lit(0.125), 2), maths.finite_or_null(F.lit(float("inf"))))
    a, b, c, d = r.first()
    assert a == 0 and math.isnan(b) and c == 0.12 and d is None


def test_macro_f1_counts_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    cells = classify.confusion(df, 3)
    assert cells.count() == 9
    s = classify.summary(classify.per_class(cells)).first()
    assert abs(s.macro_f1 - (2 / 3 + 2 / 3 + 0) / 3) < 1e-12 and abs(s.accuracy - 2 / 3) < 1e-12


def test_ranking_metrics_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.9, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(classify.auc_roc(df, "s", "y").first().auc - want) < 1e-12
    assert abs(classify.average_precision(df, "s", "y").first().average_precision - (2 / 3 * 2 / 3 + 1 / 3 * 3 / 5)) < 1e-12


def test_histogram_bins_like_numpy(spark):
    values = [*np.linspace(-6, 6, 61).tolist(), 0.2, -0.2, 5.9999, 7.0, -9.0, 1.4, 2.6]
    got = [r.n for r in profile.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", -6.0, 6.0, 60).orderBy("bin").collect()]
    edges = -6.0 + np.arange(61) * 0.2
    x = np.clip(values, -6, 6)
    assert got == [int(((x >= edges[k]) & ((x < edges[k + 1]) | (k == 59))).sum()) for k in range(60)]


def test_scaler_ignores_other_rows_and_floors(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, float("nan")), (2, 3.0)], "k int, v double")
    got = {r.k: (r.mean, r.scale) for r in profile.fit_scaler(df, ["k"]).collect()}
    assert got == {1: (2.0, 1.0), 2: (2.0, 1.0)}
    z = profile.transform(df.where("k = 1"), profile.fit_scaler(df, ["k"]), ["k"], spark.createDataFrame([(1,)], "k int"))
    assert {r.z for r in z.collect()} == {0.0}


def test_correlation_leaves_out_constant_columns(spark):
    rows = [(r, c, float(v)) for r in range(20) for c, v in ((0, r), (1, -2 * r), (2, 7))]
    got = [(r.i, r.j, round(r.r, 9)) for r in profile.correlations(spark.createDataFrame(rows, "r int, c int, v double"), "r", "c", "v").collect()]
    assert got == [(0, 1, -1.0)]


def test_ks_is_the_largest_gap(spark):
    a, b = [1.0, 2.0, 2.0, 3.0], [2.0, 4.0, 5.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, s boolean")
    grid = sorted({*a, *b})
    want = max(abs(sum(x <= g for x in a) / 4 - sum(x <= g for x in b) / 3) for g in grid)
    assert abs(profile.ks(df, "s", "v").first().ks - want) < 1e-12


def test_scores_of_windows_without_nodes(spark):
    e = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.1, True), (2, 1, 0.0, False)], "window int, node int, error double, valid boolean")
    stats = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1, 0.1)], "node int, median double, scale double")
    got = {r.window: (round(r.m1, 6), round(r.m2, 6) if r.m2 > -1e9 else r.m2, r.m3) for r in detection.window_scores(e, stats).collect()}
    assert got[1][:2] == (0.5, 2.0) and got[2] == (float("-inf"),) * 3


def test_table_diff_and_require(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-13), (2, None, 2.1), (4, "w", 4.0)], "k int, s string, v double")
    got = sorted((r.k, r.column, r.side) for r in warehouse.table_diff(a, b, ["k"]).collect())
    assert got == [(2, "v", "changed"), (3, "s", "left_only"), (3, "v", "left_only"), (4, "s", "right_only"), (4, "v", "right_only")]
    with pytest.raises(Exception, match="no zeros"):
        warehouse.require(a, F.col("v") > 1, "no zeros").collect()
    dense = warehouse.to_dense(spark.createDataFrame([(1, 1, 5.0), (1, 0, 4.0)], "k int, i int, v double"), ["k"], "i", "v", 2)
    assert dense.first()["values"] == [4.0, 5.0]


def test_strict_csv_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,level,cmdb_id,failure_type\n5,pod,x,cpu\n")
    (tmp_path / "b.csv").write_text("timestamp,level,node,failure_type\n5,pod,x,cpu\n")
    (tmp_path / "c.csv").write_text("timestamp,level,cmdb_id,failure_type\n")
    assert files.read_strict_csv(spark, f"{tmp_path}/a.csv").first().timestamp == 5
    for bad in "bc":
        with pytest.raises(Exception):
            files.read_strict_csv(spark, f"{tmp_path}/{bad}.csv").collect()
    for run, head, row in (("1", "time,m1,m2", "0,1.5,"), ("2", "time,m1", "0,2")):
        d = tmp_path / f"cases/cart_service_cpu/{run}"
        d.mkdir(parents=True)
        (d / "simple_data.csv").write_text(f"{head}\n{row}\n")
        (d / "inject_time.txt").write_text("7\n")
    got = sorted((r.service, r.fault, r.run, r.time, r.metric, repr(r.value), r.inject_time) for r in files.read_case_folders(spark, f"{tmp_path}/cases").collect())
    assert got == [("cart_service", "cpu", "1", 0, "m1", "1.5", 7), ("cart_service", "cpu", "1", 0, "m2", "nan", 7), ("cart_service", "cpu", "2", 0, "m1", "2.0", 7)]


def test_facts_json_cache_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "2024-01-01"), (2, float("inf"), "2024-01-02"), (3, float("nan"), "2024-01-03")], "timestamp long, value double, d string").select("timestamp", "value", F.to_date("d").alias("utc_date"))
    files.write_fact(df, f"{tmp_path}/fact", files_per_day=2)
    back = spark.read.parquet(f"{tmp_path}/fact")
    assert dict(back.dtypes)["utc_date"] == "date" and files.first_days(back, 2).count() == 2
    files.write_json(df, f"{tmp_path}/json")
    assert sorted(r.value or 0 for r in files.read_json(spark, f"{tmp_path}/json", "timestamp long, value double").collect()) == [0, 0, 0.5]
    assert files.build_cache([df.limit(2), df.where("timestamp = 3")], "timestamp", f"{tmp_path}/cache").count() == 3
    with pytest.raises(ValueError, match="repeated"):
        files.build_cache([df, df], "timestamp", f"{tmp_path}/cache2")
    files.write_csv(df, f"{tmp_path}/csv", ["value", "timestamp"])
    found = files.inventory(spark, f"{tmp_path}/fact").where("path like '%.parquet'")
    want = found.where("path like '%2024-01-01%'").union(spark.createDataFrame([("gone", 1, "x")], "path string, bytes long, sha256 string"))
    got = files.verify_inventory(found, want).groupBy("status").count().collect()
    assert {r.status for r in got} == {"ok", "missing", "unexpected"}
    assert [r.i for r in files.expand_spans(spark.createDataFrame([("a: 3-5, 4 - 6",)], "s string"), "s").collect()] == [3, 4, 5, 6]


def test_pickles_are_read_and_never_run(spark, tmp_path):
    class Bad:
        def __reduce__(self):
            return os.mkdir, (str(tmp_path / "ran"),)

    (tmp_path / "p").mkdir()
    (tmp_path / "p/good.pkl").write_bytes(pickle.dumps({"a": [1, 300, 70_000]}))
    (tmp_path / "p/bad.pkl").write_bytes(pickle.dumps(Bad()))
    (tmp_path / "p/junk.pkl").write_bytes(b"\xffjunk")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_pickles(spark, f"{tmp_path}/p").collect()}
    assert got["good.pkl"].numbers == [1, 300, 70_000] and not got["good.pkl"].globals and got["junk.pkl"].error
    assert any(g.endswith("mkdir") for g in got["bad.pkl"].globals) and not (tmp_path / "ran").exists()


def test_minute_state_machine():
    rule = minutes.Rule(threshold=1.0, step=60, context=2, gap=180, limit=50.0)
    values = {0: 0, 60: 0, 120: 5, 180: 0, 240: 0, 300: 0, 360: 0, 420: 0, 600: 9, 660: 9, 720: 99}  # a gap after 420
    rows = [(t, float(v)) for t, v in values.items()] + [(720, 1.0), (700, 1.0), (790, 0.0)]
    out = minutes.step(minutes.fresh(), rows, rule)
    kinds = [(k, c, t) for k, c, t, *_ in out]
    assert [x[2] for x in kinds if x[0] == "window"] == [120, 180, 240, 300, 360, 420, 720]  # 600 and 660 are context of a new segment
    assert [x for x in kinds if x[0] == "rejected"] == [("rejected", "not_after_last", 720), ("rejected", "off_grid", 700), ("rejected", "off_grid", 790)]
    assert [x for x in kinds if x[0] == "warning"] == [("warning", "out_of_range", 720)]
    score = {t: (s, r, a) for k, _, t, _, s, r, a in out if k == "window"}
    assert score[120] == (5.0, 5.0, True) and score[180] == (2.5, 5.0, True) and score[240] == (2.5, 2.5, True) and score[300] == (0.0, 2.5, True) and score[360] == (0.0, 0.0, False)
    assert score[720] == (90.0, 90.0, True)  # not the larger of it and 420's
    assert [(t, e) for k, _, t, e, *_ in out if k == "incident"] == [(120, 300)]


def stream_rows(folder, rows, spark, rule, parts):
    for k in range(parts):
        at = folder / f"in{k}"
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], "entity string, t long, value double").coalesce(1).write.parquet(f"file://{at}")
        os.makedirs(folder / "all", exist_ok=True)
        for n, f in enumerate(x for x in os.listdir(at) if x.endswith(".parquet")):
            shutil.copy(at / f, folder / "all" / f"{k}-{n}.parquet")
            os.utime(folder / "all" / f"{k}-{n}.parquet", (1000 + k, 1000 + k))
    return minutes.run_to_end(minutes.minute_alerts(minutes.replay(spark, f"file://{folder}/all", "entity string, t long, value double"), rule), f"file://{folder}/out").collect()


def test_stream_equals_one_pass_and_keeps_state(spark, tmp_path):
    rule = minutes.Rule(threshold=0.4)
    rows = [("a", t, float(t // 60 % 17 in (0, 1))) for t in range(0, 12_000, 60) if t % 2460]
    got = stream_rows(tmp_path, rows, spark, rule, 3)
    state = minutes.fresh()
    want = [(*r, False if r[0] == "incident" else None) for r in minutes.step(state, [(t, v) for _, t, v in rows], rule)]
    if state["open"] and state["open"][0] < state["open"][1]:
        want.append(("incident", "open", *state["open"], None, None, None, state["open"][1] == state["window"]))
    assert sorted(map(repr, (tuple(r)[1:] for r in got))) == sorted(map(repr, want)) and len({w[0] for w in want}) == 2


def test_replay_of_all_events_equals_its_sql(spark):
    import duckdb

    from pulsegrid.plans import registry

    d, con = "/root/testdata/sf0.1", duckdb.connect()
    con.sql(f"create view events as select * from '{d}/events.parquet'")
    out = registry.queries()["stream_replay"](spark, d)
    want = con.sql(registry.oracle_sql()["stream_replay"])
    cols = sorted(out.columns)
    rows = out.select(*cols).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.select(*cols).fetchall()))
    assert len({r.entity for r in rows}) == 5


def test_predictor_is_vectorised(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(models.predictor(lambda m: m * 2)(F.col("x"))).collect()] == [[2.0, 4.0], None]
    e = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "e array<double>")
    assert e.select(*(f(F.col("e")).alias(n) for n, f in models.SCORING_RULES.items())).first().asDict() == {"window_mean": 3.5, "last_step": 6.0, "last_five": 4.0}


def test_every_query_equals_its_sql(spark):
    import duckdb

    from pulsegrid.plans import registry

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    wrong = []
    for name, sql in registry.oracle_sql().items():
        df, want = registry.queries()[name](spark, d), con.sql(sql)
        cols = sorted(df.columns)
        rows = lambda x: sorted(tuple(map(text, r)) for r in x)
        if cols != sorted(want.columns) or rows(df.select(*cols).collect()) != rows(want.select(*(f'"{c}"' for c in cols)).fetchall()):
            wrong.append(name)
    assert not wrong and len(registry.oracle_sql()) > 100


def test_every_event_is_rounded(spark):
    import duckdb

    from pulsegrid.plans import registry

    d = "/root/testdata/sf0.01"
    got = {r.event_id: (r.even, r.safe, r.undefined) for r in registry.queries()["rounding"](spark, d).collect()}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{d}/events.parquet'")
    want = {r[0]: r[1:] for r in con.sql(registry.oracle_sql()["rounding"]).fetchall()}
    assert got == want and len(got) == spark.read.parquet(f"{d}/events.parquet").count() and any(k % 7 for k in got)


def test_flagship_counts(spark, small):
    from pulsegrid.plans import registry

    want = {"sf0.001": (2, 14, 0, 2, False), "sf0.01": (174, 170, 14, 160, True), "sf0.1": (815, 1795, 1623, 210, True)}
    for sf, row in want.items():
        r = registry.queries()["event_scoring"](spark, f"/root/testdata/{sf}").first()
        assert (r.n_intervals, r.n_labels, r.tp, r.fp, r.scored) == row


def test_the_entry_works_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pulsegrid", tmp_path / "pulsegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120).returncode == 0


def test_the_entry_works_without_a_library_of_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.exists(f"{root}/pulsegrid/llm"):
        pytest.skip("the optional parts aren't there")
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('no such library')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, timeout=120).returncode == 0


def test_draws_reach_every_row(spark):
    n = spark.createDataFrame([(3_000_000,)], "n long")
    r = classify.draws(n, 1, 5).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_distinct("i").alias("i")).first()
    assert r.n == r.i == 3_000_000 and r.lo < 10 and 2_999_990 < r.hi < 3_000_000
    got = classify.draws(n.select(F.lit(23).alias("n")), 3, 5, block=7).orderBy("b", "i").collect()
    assert [x.i for x in got] == [*range(23)] * 3 and all(0 <= x["at"] < 23 for x in got)
    assert all(y["at"] == x["at"] + 1 for x, y in zip(got[:-1], got[1:], strict=True) if y.i % 7)
    assert classify.draws(n.where("n < 0"), 3, 5).count() == 0
