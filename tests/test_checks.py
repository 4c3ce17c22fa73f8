"""Checks, masks, JSON trees and stored tensors."""

import io
import pickle
import struct
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import trees
from pulsegrid.operators import checks
from pulsegrid.sources import tensors

WINDOWS = "start long, target long"


def test_leakage_finds_what_is_planted(spark):
    w = spark.createDataFrame([(0, 360), (60, 420), (900, 1260), (1200, 1560)], WINDOWS)
    cases = spark.createDataFrame([(1, 100), (2, 1000), (3, 5000)], "case_id long, t long")
    roles = checks.window_roles(w, 1200, 700)
    assert sorted((r.start, r.role) for r in roles.collect()) == [(0, "fit"), (60, "fit"), (900, "embargo"), (1200, "validation")]
    clean = {r.check: r.violations for r in checks.leakage(roles, cases, 1200, 700, 60, 360).collect()}
    assert set(clean.values()) == {0} and len(clean) == 7
    bad = roles.union(spark.createDataFrame([(60, 420, "validation")], f"{WINDOWS}, role string"))
    found = {r.check: r.violations for r in checks.leakage(bad, cases, 1200, 700, 60, 360).collect()}
    assert found == clean | {"validation_starts_early": 1, "shared_moments": 7, "case_on_both_sides": 1, "repeated_window": 1}
    assert {r.case_id: r.role for r in checks.case_roles(bad, cases, 360).collect()} == {1: "both", 2: "none", 3: "none"}


def test_leakage_of_empty_tables(spark):
    w = checks.window_roles(spark.createDataFrame([], WINDOWS), 10, 5)
    got = {r.check: r.violations for r in checks.leakage(w, spark.createDataFrame([], "case_id long, t long"), 10, 5, 60, 360).collect()}
    assert set(got.values()) == {0}


def test_schema_issues_never_raise(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert checks.schema_issues(df, {"x": "int", "y": "string"}) == []
    assert checks.schema_issues(df, {"x": "bigint", "z": "int"}) == ["missing z", "x is int, not bigint", "unexpected y"]


def test_masks_and_splits_repeat(spark):
    df = spark.range(4000).select("id", (F.col("id") % 10).alias("g"))
    share = df.agg(F.avg(checks.mask_of([F.col("id")], 0.3, "a").cast("int"))).first()[0]
    assert abs(share - 0.3) < 0.03
    a, b = (sorted(map(tuple, checks.seeded_split(df, "g", "id", "s", (("train", 3), ("test", 1))).collect())) for _ in "ab")
    assert a == b and sum(r[3] == "train" for r in a) == 30 and sum(r[3] == "test" for r in a) == 10 and sum(r[3] is None for r in a) == 3960


def test_trees(spark):
    a = spark.createDataFrame([(1, '{"a":{"b":[1,{"test":2.5}]},"c":"x"}'), (2, "[]"), (3, None)], "id int, j string")
    b = spark.createDataFrame([(1, '{"a":{"b":[1.0,{"test":2.6}]},"c":"x"}'), (2, "[3]")], "id int, j string")
    assert {r.path: r.value for r in trees.flatten(a, ["id"], "j").collect()} == {"$.a": None, "$.c": '"x"', "$.a.b": None, "$.a.b[0]": "1", "$.a.b[1]": None, "$.a.b[1].test": "2.5"}
    assert [(r.id, r.path) for r in trees.keys_like(a, ["id"], "j", "^test").collect()] == [(1, "$.a.b[1].test")]
    assert sorted((r.id, r.path, r.side) for r in trees.tree_diff(a, b, ["id"], "j").collect()) == [(1, "$.a.b[1].test", "changed"), (2, "$[0]", "right_only")]
    with pytest.raises(Exception, match="too deep"):
        trees.flatten(a, ["id"], "j", depth=2).collect()


class _Stored:
    """Pickles as a tensor does: a call of a name that only the real library has."""

    def __init__(self, make, args):
        self.args = make, args

    def __reduce__(self):
        return self.args


def _tensor_files(monkeypatch, array, kind, strides=None, offset=0, shape=None):
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    setattr(torch, kind, type(kind, (), {"__module__": "torch", "__qualname__": kind}))

    def _rebuild_tensor_v2(*a):
        raise AssertionError("never called")

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    mark = types.SimpleNamespace(key="0")

    class Writer(pickle.Pickler):
        def persistent_id(self, obj):
            return ("storage", getattr(torch, kind), "0", "cpu", array.size) if obj is mark else None

    shape = shape or array.shape
    strides = strides or tuple(s // array.itemsize for s in array.strides)
    out = io.BytesIO()
    Writer(out, 2).dump({"w": [_Stored(_rebuild_tensor_v2, (mark, offset, shape, strides, False, {}))]})
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("m/data.pkl", out.getvalue())
        z.writestr("m/data/0", array.tobytes())
    old = b"".join(pickle.dumps(x, 2) for x in (1, 1001, {"little_endian": True})) + out.getvalue() + pickle.dumps(["0"], 2) + struct.pack("<q", array.size) + array.tobytes()
    return zipped.getvalue(), old


def test_tensors_of_both_layouts(spark, tmp_path, monkeypatch):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    for data in _tensor_files(monkeypatch, a, "FloatStorage"):
        assert [(n, x.tolist()) for n, x in tensors.tensors(data)] == [("w[0]", a.tolist())]
    for data in _tensor_files(monkeypatch, a, "FloatStorage", (1, 4), 1, (2, 3)):
        assert next(tensors.tensors(data))[1].tolist() == a.T[1:3, :3].tolist()
    half = (np.array([1.5, -2.0], np.float32).view(np.uint32) >> 16).astype(np.uint16)
    assert next(tensors.tensors(_tensor_files(monkeypatch, half, "BFloat16Storage")[0]))[1].tolist() == [1.5, -2.0]
    good, _ = _tensor_files(monkeypatch, a, "FloatStorage")
    beyond, _ = _tensor_files(monkeypatch, a, "FloatStorage", (4, 1), 8, (3, 4))
    (tmp_path / "good.pt").write_bytes(good)
    (tmp_path / "beyond.pt").write_bytes(beyond)
    (tmp_path / "junk.pt").write_bytes(b"junk")
    (tmp_path / "evil.pt").write_bytes(b"".join(pickle.dumps(x) for x in (1, 2, 3)) + b"cos\nmkdir\n(V" + str(tmp_path / "ran").encode() + b"\ntR.")
    got = {r.path.rsplit("/", 1)[1]: r for r in tensors.read_tensors(spark, str(tmp_path)).collect()}
    assert got["good.pt"].shape == [3, 4] and got["good.pt"]["values"] == a.ravel().tolist() and got["good.pt"].error is None
    assert "beyond its storage" in got["beyond.pt"].error and got["junk.pt"].error and "may not be read" in got["evil.pt"].error and not (tmp_path / "ran").exists()
