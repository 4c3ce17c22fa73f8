"""Diagnostics, protocol checks, archives and alert sinks."""

import io
import math
import random
import stat
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import models, networks
from pulsegrid.operators import checks, detection, diagnostics, ordered, profile, warehouse
from pulsegrid.sources import archives
from pulsegrid.streaming import minutes, sinks


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 2.0, 5.0], "many"])
def test_grid_quantiles_equal_linear_percentiles(spark, values):
    random_ = random.Random(3)
    values = [round(random_.gauss(0, 50), random_.choice([0, 3])) for _ in range(700)] + [0.0] * 40 + [1e-9, -1e-9] if values == "many" else values
    counts = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.k: (r.tau, r.upto) for r in ordered.grid_quantiles(counts, "v", "n", 40).collect()}
    assert len(got) == (41 if values else 0)
    for k, (tau, upto) in got.items():
        assert abs(tau - np.percentile(values, 100 * k / 40)) < 1e-9
        assert upto == sum(v <= sorted(values)[int((len(values) - 1) * k // 40)] for v in values)


def test_cumulative_in_the_order_of_any_numbers(spark):
    values = [-math.inf, -1e300, -5.0, -5e-324, 0.0, 5e-324, 0.1, 3.0, 3.0000001, 1e300, math.inf]
    df = spark.createDataFrame([(v, k + 1) for k, v in enumerate(values)], "v double, n long").repartition(4)
    got = {r.v: (r.before_n, r.all_n) for r in ordered.cumulative(df, "v", ["n"]).collect()}
    assert got == {v: (sum(range(1, k + 1)), 66) for k, v in enumerate(values)}
    assert ordered.cumulative(df.limit(0), "v", ["n"]).count() == 0


def test_effective_sample_size(spark):
    random_, x = random.Random(2), [0.0]
    for _ in range(299):
        x.append(0.8 * x[-1] + random_.gauss(0, 1))
    c = np.array(x) - np.mean(x)
    rho, total = [(c[:-k] * c[k:]).sum() / (c * c).sum() for k in range(1, 76)], 0.0
    for r in rho:
        if r <= 0:
            break
        total += r
    df = spark.createDataFrame([*enumerate(x)], "t long, x double")
    for block in (1, 4, 100):
        r = diagnostics.effective_sample_size(df, "t", "x", block).first()
        assert r.n == 300 and abs(r.ess - 300 / (1 + 2 * total)) < 1e-6
    assert diagnostics.effective_sample_size(df.limit(0), "t", "x").count() == 0


def test_tail_thresholds_fall_back_on_percentiles(spark):
    random_ = random.Random(5)
    rows = [("a", random_.expovariate(1.0)) for _ in range(20_000)] + [("few", float(k)) for k in range(20)] + [("same", 1.0)] * 2000 + [(None, 2.0), ("a", None), ("void", None)]
    got = {r.k: r for r in diagnostics.tail_threshold(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert not got["a"].fallback and abs(got["a"].threshold - math.log(1000)) < 0.7 and abs(got["a"].gamma) < 0.2
    assert got["few"].fallback and abs(got["few"].threshold - 18.981) < 1e-9 and got["same"].fallback and got["same"].threshold == 1.0
    assert got[None].threshold == 2.0 and got["void"].n == 0 and got["void"].threshold is None and len(got) == 5


def test_tails_are_the_likeliest(spark):
    """No shape and scale near the fitted ones, or on a coarse grid of all, makes the excesses likelier."""
    random_ = random.Random(8)
    draw = {"heavy": lambda u: (u**-0.4 - 1) / 0.4, "light": lambda u: (1 - u**0.3) / 0.3, "huge": lambda u: 1e6 * (u**-0.9 - 1), "short": lambda u: 1 - u}
    rows = [(k, f(1 - random_.random())) for k, f in draw.items() for _ in range(6000)]
    for r in diagnostics.tail_threshold(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", level=0.9).collect():
        y = np.array([x for k, x in rows if k == r.k and x > r.start]) - r.start

        def fit(gamma, sigma, y=y):
            z = 1 + gamma * y / sigma
            return -np.inf if z.min() <= 0 else -len(y) * math.log(sigma) - (1 + 1 / gamma) * np.log(z).sum()

        best = fit(r.gamma, r.sigma)
        assert r.n_over == len(y) and not r.fallback and r.gamma >= -0.5
        tried = [(r.gamma + a, r.sigma * b) for a in (-0.1, -0.01, 0.01, 0.1) for b in (0.9, 0.99, 1, 1.01, 1.1)] + [(g / 20, r.sigma * 2**s) for g in range(-10, 40) if g for s in range(-4, 5)]
        near_edge = r.k == "short"  # its shape is -1, so the fit stops at -1/2
        assert near_edge and r.gamma < -0.49 or max(fit(g, s) for g, s in tried) <= best + 1e-3, (r, best)
        assert abs(r.threshold - (r.start + r.sigma / r.gamma * ((0.001 * r.n / len(y)) ** -r.gamma - 1))) < 1e-6 * r.threshold


def test_ks_p_value(spark):
    rows = [(k < 100, float(k % 100) + (30 if k < 100 else 0)) for k in range(200)]
    r = profile.ks(spark.createDataFrame(rows, "s boolean, v double"), "s", "v").first()
    x = r.ks * math.sqrt(50)
    assert abs(r.ks - 0.3) < 1e-12 and abs(r.p_value - 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 60))) < 1e-12
    same = profile.ks(spark.createDataFrame([(k < 50, float(k % 50)) for k in range(100)], "s boolean, v double"), "s", "v").first()
    assert (same.ks, same.p_value) == (0.0, 1.0)


def test_wrapped_ints_and_collation(spark):
    df = spark.createDataFrame([([],), ([1, 2],), ([*range(5)],)], "v array<int>")
    assert [r[0] for r in df.select(diagnostics.wrapped_ints(F.col("v"), 2)).collect()] == ["[]", "[1, 2]", "[\n    0, 1,\n    2, 3,\n    4\n  ]"]
    got = diagnostics.collated(spark.createDataFrame([("a", None), ("b", 0), ("c", -1)], "k string, c int"), ["c"]).collect()
    assert [tuple(r) for r in got] == [("a", -1, False), ("b", 0, True), ("c", -1, False)]


def test_declared_mask_takes_the_first_type(spark):
    nodes = spark.createDataFrame([("node-1",), ("node-2-x",), ("pod-1",)], "node string")
    channels = spark.createDataFrame([("system.a", "metric"), ("kpi.b", "metric"), ("t", "trace")], "channel string, modality string")
    rule = [("vm", "node-", {"metric": "system."}), ("pod", None, {"metric": "kpi", "trace": ""})]
    assert sorted(map(tuple, diagnostics.declared_mask(nodes, channels, rule).collect())) == [("pod", "metric", 1, 1, 1), ("pod", "trace", 1, 1, 1), ("vm", "metric", 2, 1, 2)]
    with pytest.raises(ValueError, match="default"):
        diagnostics.declared_mask(nodes, channels, rule[:1])


def test_union_check_counts_both_ways(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (3, None), (4, 4.0)], "k int, v double")
    assert tuple(warehouse.union_check(a, b).first()) == (1, 2, 4, 5)
    assert tuple(warehouse.union_check(a.limit(0), a.limit(0)).first()) == (0, 0, 0, 0)


def test_windows_longer_than_a_day_keep_their_guard(spark):
    w = spark.createDataFrame([(0, 200_000), (300_000, 500_000), (800_000, 800_060)], "start long, target long")
    labels = spark.createDataFrame([(1, 0, 100_000), (2, 1, 500_100)], "case_id long, class long, t long")
    got = {r.start: (r.category, r.case_id) for r in detection.window_categories(w, labels, (60, 300), (60, 300)).collect()}
    assert got == {0: ("ignore", None), 300_000: ("normal_reference", None), 800_000: ("normal_reference", None)}
    got = {r.start: (r.category, r.case_id) for r in detection.window_categories(w, labels, (200, 300), (200, 300)).collect()}
    assert got[300_000] == ("event_associated", 2)


def test_split_leakage_finds_what_is_planted(spark):
    schema = "start long, target long, role string, category string, case_id long, fault long, reason string"
    clean = [(0, 360, "fit", "event_associated", 1, 0, None), (1300, 1660, "calibration", "event_associated", 2, 1, None), (700, 1060, "embargo", "normal_reference", None, -1, None), (5000, 5360, "test", "event_associated", None, -1, "ambiguous")]
    cases = spark.createDataFrame([(1, 100, 10), (2, 1400, 20), (3, 5100, 30)], "case_id long, t long, grp long")
    found = lambda rows, c=cases: {r.check: r.violations for r in checks.split_leakage(spark.createDataFrame(rows, schema), c, 1200, 300, 4000, 60).collect()}
    assert set(found(clean).values()) == {0} and len(found(clean)) == 10
    bad = found([*clean, (1360, 1720, "fit", "event_associated", 2, -1, None)])
    assert {k for k, v in bad.items() if v} == {"l1_shared_moment", "l2_case_on_both_sides", "l3_group_on_both_sides", "l4_train_case_not_on_one_side", "l5_window_leaves_its_region", "l9_unexplained_event_window"}
    one_group = spark.createDataFrame([(1, 100, 10), (2, 1400, 10), (3, 5100, 30)], "case_id long, t long, grp long")
    assert {k for k, v in found(clean, one_group).items() if v} == {"l3_group_on_both_sides", "l7_cut_inside_a_group"}
    bad = found([*clean, (4100, 4460, "fit", "normal_reference", None, -1, "ambiguous"), (2000, 2360, "embargo", "ignore", None, -1, None)])
    assert {k for k, v in bad.items() if v} == {"l5_window_leaves_its_region", "l6_role_outside_its_period", "l8_stray_embargo", "l10_inconsistent_reason"}


def packed(*entries):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            if data == "link":
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, data)
    return sink.getvalue()


def test_archives_give_out_only_what_is_safe(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(packed(("ok/file.txt", "text"), ("../up", "x"), ("/root", "x"), ("a/../../b", "x"), ("C:/x", "x"), ("l", "link"), ("__MACOSX/f", "x"), ("bomb", "0" * 200_000)))
    (tmp_path / "in/b.zip").write_bytes(b"no archive")
    found = archives.read_archives(spark, f"file://{tmp_path}/in")
    assert {r.member: r.status for r in found.collect()} == {"ok/file.txt": "ok", "../up": "unsafe_path", "/root": "unsafe_path", "a/../../b": "unsafe_path", "C:/x": "unsafe_path", "l": "symlink", "__MACOSX/f": "skipped", "bomb": "too_large", "": "damaged"}
    assert archives.extract(found, f"file://{tmp_path}/out") == 1
    assert [str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["ok/file.txt"]
    assert (tmp_path / "out/ok/file.txt").read_text() == "text"
    assert [m[1] for m in archives.members(packed(("a", "12345"), ("b", "12345")), most=7)] == ["ok", "too_large"]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("f", "payload")
    raw = bytearray(plain.getvalue())
    raw[raw.index(b"payload")] ^= 1
    assert [m[1] for m in archives.members(bytes(raw))] == ["damaged"]


def test_alerts_reach_every_sink(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, t long").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: minutes.replay(spark, f"file://{tmp_path}/in", "k string, t long")
    seen, told = [], []
    take = lambda batch, n: seen.extend(r.k for r in batch.collect())
    sinks.fan_out(stream(), {"list": take, "folder": sinks.folder_sink(f"file://{tmp_path}/out")}, f"file://{tmp_path}/cp", lambda *x: told.append(x)).awaitTermination()
    assert sorted(seen) == ["a", "b"] and told == [("list", 0, "delivered"), ("folder", 0, "delivered")]
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2

    def broken(batch, n):
        raise OSError("no way")

    told.clear()
    with pytest.raises(Exception, match="no way"):
        sinks.fan_out(stream(), {"broken": broken, "list": take}, f"file://{tmp_path}/cp2", lambda *x: told.append(x)).awaitTermination()
    assert told == [("broken", 0, "OSError: no way"), ("list", 0, "delivered")] and len(seen) == 4


def test_boosted_classifier(spark):
    random_ = random.Random(1)
    rows = [([random_.gauss(3 * (k == 0), 1), random_.gauss(3 * (k == 1), 1), random_.gauss(0, 1)], k) for k in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y int").repartition(2)
    out = models.boosted_classifier(df, "x", "y", rounds=5)(df)
    assert out.columns == ["x", "y", "pred"] and out.where("pred = y").count() > 150


def looped_attention(w, name, x, heads, there):
    """Attention one query, head and key at a time."""
    places, d = x.shape
    size, qkv = d // heads, x @ w[f"{name}.qkv.w"] + w[f"{name}.qkv.b"]
    out = np.zeros((places, d))
    for q in range(places):
        for h in range(heads):
            one = lambda at, part, h=h: qkv[at, part * d + h * size : part * d + (h + 1) * size]
            weight = {k: math.exp(sum(a * b for a, b in zip(one(q, 0), one(k, 1), strict=True)) / math.sqrt(size)) for k in range(places) if there[k]}
            for k, e in weight.items():
                out[q, h * size : (h + 1) * size] += e / sum(weight.values()) * one(k, 2)
    return out @ w[f"{name}.out.w"] + w[f"{name}.out.b"]


def test_attention_and_fusion_leave_out_what_is_missing():
    rng, w = np.random.default_rng(1), networks.core_weights(3, d=6, steps=5, types=3, classes=4, channels=2, layers=2)
    x, there = rng.normal(size=(7, 4, 6)), rng.random((7, 4)) < 0.6
    there[0] = False
    got = networks.attend(w, "0.node", np.where(there[..., None], x, 0.0), 3, there)
    for k in range(7):
        assert np.allclose(got[k], looped_attention(w, "0.node", np.where(there[k][:, None], x[k], 0.0), 3, there[k]))
    fused = networks.fuse(w, np.where(there[..., None], x, np.nan), there)
    assert np.allclose(fused[0], w["missing"])
    for k in range(1, 7):
        gates = [1 / (1 + math.exp(-(x[k, m] @ w["gate.w"][:, 0] + w["gate.b"][0]))) for m in range(4) if there[k, m]]
        held = [x[k, m] for m in range(4) if there[k, m]]
        want = sum(g * v for g, v in zip(gates, held, strict=True)) / sum(gates) if held else w["missing"]
        assert np.allclose(fused[k], want, atol=1e-7)


def test_network_of_windows():
    rng, w = np.random.default_rng(4), networks.core_weights(3, d=6, steps=5, types=3, classes=4, channels=2, layers=2)
    tokens, there, valid, kind = rng.normal(size=(3, 5, 4, 2, 6)), rng.random((3, 5, 4, 2)) < 0.7, np.ones((3, 4), bool), np.array([0, 1, 2, 1])
    valid[1, 2], valid[2] = False, False
    h = networks.core(w, tokens, there, kind, valid, heads=2, layers=2)
    spoilt = np.where((there & valid[:, None, :, None])[..., None], tokens, np.nan)
    assert np.isfinite(h).all() and np.array_equal(h, networks.core(w, spoilt, there, kind, valid, heads=2, layers=2))
    assert not h[2].any() and not h[1, :, 2].any() and h[0].any()
    order = [2, 0, 3, 1]
    assert np.allclose(h[:, :, order], networks.core(w, tokens[:, :, order], there[:, :, order], kind[order], valid[:, order], heads=2, layers=2))
    some = [0, 1, 3]
    alone = networks.core(w, tokens[1:2, :, some], there[1:2, :, some], kind[some], np.ones((1, 3), bool), heads=2, layers=2)
    assert np.allclose(h[1:2, :, some], alone)
    z, ahead = networks.fault_logits(w, h, valid), networks.next_values(w, h, kind, valid)
    assert z.shape == (3, 4) and np.allclose(z[1:2], networks.fault_logits(w, alone, np.ones((1, 3), bool))) and not ahead[2].any()
    assert np.allclose(z[2], networks.gelu(w["fault.1.b"]) @ w["fault.2.w"] + w["fault.2.b"])
    assert np.allclose(ahead[0, 3], h[0, -1, 3] @ w["next.w"][1] + w["next.b"][1])
    with pytest.raises(ValueError, match="node type"):
        networks.core(w, tokens, there, np.array([0, 1, 2, 3]), valid, heads=2, layers=2)
    with pytest.raises(ValueError, match="minutes"):
        networks.core(w, tokens[:, :4], there[:, :4], kind, valid, heads=2, layers=2)


@pytest.mark.parametrize("latent", [None, 2])
def test_autoencoder_of_loops(latent):
    w, x = networks.autoencoder_weights(5, inputs=3, hidden=4, layers=2, latent=latent), np.random.default_rng(6).normal(size=(2, 7, 3))
    s = lambda v: 1 / (1 + math.exp(-v))

    def run(name, steps, first):
        hs, cs, out = [list(first), list(first)], [[0.0] * 4, [0.0] * 4], []
        for row in steps:
            for k in range(2):
                z = [sum(a * w[f"{name}.{k}.in"][i, j] for i, a in enumerate(row)) + sum(a * w[f"{name}.{k}.back"][i, j] for i, a in enumerate(hs[k])) + w[f"{name}.{k}.b"][j] for j in range(16)]
                cs[k] = [s(z[4 + u]) * cs[k][u] + s(z[u]) * math.tanh(z[8 + u]) for u in range(4)]
                hs[k] = row = [s(z[12 + u]) * math.tanh(cs[k][u]) for u in range(4)]
            out.append(row)
        return np.array(out)

    got = networks.rebuilt(w, x, layers=2)
    for k in range(2):
        code = run("encoder", x[k], [0.0] * 4)[-1]
        if latent:
            code = (code @ w["latent.w"] + w["latent.b"]) @ w["context.w"] + w["context.b"]
        assert np.allclose(got[k], run("decoder", [code] * 7, code) @ w["output.w"] + w["output.b"])
