"""The test lock, the cache by time of change, members of remote archives, and minutes over HTTP."""

import io
import json
import random
import stat
import threading
import zipfile
from contextlib import contextmanager
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import freeze
from pulsegrid.sources import archives, cache, files
from pulsegrid.streaming import http, minutes


@contextmanager
def running(server):
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


class Ranges(SimpleHTTPRequestHandler):
    """A file server that answers range requests, and says what it was asked."""

    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        data = open(self.translate_path(self.path), "rb").read()
        first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        self.asked.append((first, last))
        self.send_response(206)
        self.send_header("Content-Length", str(len(data[first : last + 1])))
        self.end_headers()
        self.wfile.write(data[first : last + 1])


def test_the_test_run_is_claimed_once(spark, tmp_path):
    work, record, markers = tmp_path / "work", f"{tmp_path}/record", [f"{tmp_path}/m/a.json", f"{tmp_path}/m/b.json"]
    work.mkdir()
    for k in range(4):
        (work / f"{k}.txt").write_text(f"file {k}")
    found = lambda: files.inventory(spark, str(work))
    sign = freeze.freeze(found(), record)
    assert sign == freeze.digest(found().orderBy(F.desc("path"))) and freeze.problems(found(), record) == []
    rows = spark.createDataFrame([("fit", 1), ("calibration", 2), ("validation", 3), ("test", 4), (None, 5)], "role string, n int")
    scored = lambda t=None: sorted(r.n for r in freeze.scorable(rows, "role", t).collect())
    assert scored() == [2, 3]
    (work / "0.txt").write_text("other")
    (work / "1.txt").unlink()
    (work / "new.txt").write_text("")
    assert [p.split(":")[0] for p in freeze.problems(found(), record)] == ["changed", "missing", "unexpected", "3 files differ"]
    with pytest.raises(freeze.FreezeError, match="changed"):
        freeze.claim(found(), record, markers)
    assert not (tmp_path / "m").exists()
    (work / "0.txt").write_text("file 0")
    (work / "1.txt").write_text("file 1")
    (work / "new.txt").unlink()
    token = freeze.claim(found(), record, markers)
    assert token.digest == sign and scored(token) == [2, 3, 4]
    with pytest.raises(freeze.FreezeError, match="claimed before"):
        freeze.claim(found(), record, markers)
    assert freeze.resume(found(), record, markers, token.run_id) == token
    for wrong in ("", "other"):
        with pytest.raises(freeze.FreezeError, match="no marker"):
            freeze.resume(found(), record, markers, wrong)
    (work / "2.txt").write_text("later")
    with pytest.raises(freeze.FreezeError, match="changed"):
        freeze.resume(found(), record, markers, token.run_id)
    with pytest.raises(freeze.FreezeError, match="token"):
        freeze.scorable(rows, "role", "let me in")


def test_an_unfinished_marker_refuses_too(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x")
    found = files.inventory(spark, f"{tmp_path}/f.txt")
    freeze.freeze(found, f"{tmp_path}/record")
    (tmp_path / "m.json").write_text("")
    with pytest.raises(freeze.FreezeError, match="claimed before"):
        freeze.claim(found, f"{tmp_path}/record", [f"{tmp_path}/m.json"])
    with pytest.raises(freeze.FreezeError, match="no marker"):
        freeze.resume(found, f"{tmp_path}/record", [f"{tmp_path}/m.json"], "x")


def test_cache_by_change_and_by_age(spark, tmp_path):
    clock, made = [0.0], []
    held, path = cache.Cache(spark, ttl=10, now=lambda: clock[0]), f"{tmp_path}/t"
    assert held.table(path) is None
    spark.range(3).write.parquet(path)
    first = held.table(path)
    assert first.count() == 3 and held.table(path) is first and first.is_cached
    spark.range(2).write.mode("append").parquet(path)
    second = held.table(path)
    assert second is not first and second.count() == 5 and not first.is_cached
    make = lambda: made.append(1) or spark.range(7)
    one = held.query("q", make)
    clock[0] = 9.9
    assert held.query("q", make) is one and len(made) == 1
    clock[0] = 10.0
    assert held.query("q", make).count() == 7 and len(made) == 2
    held.clear()
    assert not second.is_cached and held.table(path) is not second
    held.clear()


def test_members_of_remote_archives(spark, tmp_path):
    random_, sink = random.Random(3), io.BytesIO()
    big = random_.randbytes(5 << 20)
    link = zipfile.ZipInfo("link")
    link.external_attr = (stat.S_IFLNK | 0o777) << 16
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.bin", random_.randbytes(9 << 20))
        z.writestr("a/big.bin", big)
        z.writestr(zipfile.ZipInfo("plain.txt"), "stored")
        z.writestr("zeros.bin", b"\0" * (4 << 20))
        z.writestr("empty", "")
        z.writestr(link, "x")
    data = bytearray(sink.getvalue())
    (tmp_path / "good.zip").write_bytes(data)
    data[data.index(b"stored")] ^= 1
    (tmp_path / "bad.zip").write_bytes(data)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    with running(ThreadingHTTPServer(("127.0.0.1", 0), partial(Ranges, directory=str(tmp_path)))) as base:
        names = [("good", m) for m in ("a/big.bin", "plain.txt", "zeros.bin", "empty", "link", "nowhere")] + [("bad", "plain.txt"), ("none", "plain.txt")]
        wanted = spark.createDataFrame([(f"{base}/{a}.zip", m, f"file://{tmp_path}/out/{a}-{m.replace('/', '-')}") for a, m in names] + [(None, "x", "y")], "url string, member string, target string")
        status = lambda: {(r.url.rsplit("/", 1)[1][:-4], r.member): (r.status, r.size) for r in archives.fetch_members(wanted).collect()}
        want = {("good", "a/big.bin"): ("fetched", 5 << 20), ("good", "plain.txt"): ("fetched", 6), ("good", "zeros.bin"): ("too_large", 4 << 20), ("good", "empty"): ("fetched", 0), ("good", "link"): ("symlink", 1)}
        want |= {("good", "nowhere"): ("missing", 0), ("bad", "plain.txt"): ("damaged", 0), ("none", "plain.txt"): ("damaged", 0)}
        assert status() == want
        assert (tmp_path / "out/good-a-big.bin").read_bytes() == big
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["good-a-big.bin", "good-empty", "good-plain.txt"]
        assert status() == {k: ("present" if s == "fetched" else s, n) for k, (s, n) in want.items()}
        (tmp_path / "out/good-plain.txt").write_text("stired")
        assert archives.fetch_member(f"{base}/good.zip", "plain.txt", f"file://{tmp_path}/out/good-plain.txt")[0] == "fetched"
        assert (tmp_path / "out/good-plain.txt").read_text() == "stored"
        assert archives.fetch_member(f"{base}/good.zip", "a/big.bin", f"file://{tmp_path}/again")[2] < (5 << 20) + 3 * archives.RANGE + 1024


def test_a_server_without_ranges_is_an_error(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK" * 4000)

    class Whole(SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    with running(ThreadingHTTPServer(("127.0.0.1", 0), partial(Whole, directory=str(tmp_path)))) as base, pytest.raises(OSError, match="no ranges"):
        archives.fetch_member(f"{base}/a.zip", "x", f"file://{tmp_path}/x")


def test_minutes_over_http_equal_one_pass(spark):
    rule, random_ = minutes.Rule(threshold=1.0), random.Random(4)
    rows = [[60 * k, round(random_.gauss(0, 0.6) + 3 * (80 < k < 86 or k > 195), 6)] for k in range(200)]
    state = minutes.fresh()
    want = minutes.step(state, [tuple(r) for r in rows], rule)
    with running(http.serve(rule)) as base:
        got, held = [], None
        for first in range(0, 200, 33):
            status, text = http.call(f"{base}/v1/predict", {"minutes": rows[first : first + 33], "state": held})
            answer = json.loads(text)
            held = answer["state"]
            assert status == 200
            got += [tuple(r[c] for c in minutes.COLUMNS[1:]) for r in answer["rows"] if r["code"] != "open"]
        assert got == want and held == state
        last = answer["rows"][-1]
        assert (last["kind"], last["code"], last["end_t"]) == ("incident", "open", state["open"][1]) and last["may_continue"] == (state["open"][1] == state["window"])
        code = lambda body, path="/v1/predict", **k: (lambda s, t: (s, json.loads(t)["error"]["code"]))(*http.call(base + path, body, **k))
        assert code({"minutes": rows[:3], "state": held}) == (400, "not_after_last")
        assert code({"minutes": [rows[0], rows[2]]}) == (400, "not_consecutive")
        assert code({"minutes": [[61, 1.0]]}) == (400, "off_grid")
        assert code({"minutes": [[60, None]]}) == code({"minutes": [[60, True]]}) == code({"minutes": [[0.5, 1]]}) == code({"minutes": [3]}) == (400, "bad_minute")
        assert code({"minutes": []}) == code({}) == (400, "bad_minutes")
        assert code([]) == (400, "bad_request")
        assert code({"minutes": rows * 9}) == (400, "too_many_minutes")
        for off in (3, {}, {**state, "recent": [None]}, {**state, "recent": [0.0] * 9}, {**state, "open": [1]}, {**state, "last": "x"}):
            assert code({"minutes": [[60 * 500, 1.0]], "state": off}) == (400, "bad_state")
        assert code({}, headers={"Content-Type": "text/plain"}) == (415, "unsupported_media_type")
        assert code(None) == (405, "method_not_allowed") and code({}, "/healthz") == (405, "method_not_allowed") and code(None, "/x") == code({}, "/x") == (404, "not_found")
        assert json.loads(http.call(f"{base}/healthz")[1])["status"] == "ok" and json.loads(http.call(f"{base}/v1/metadata")[1])["rule"]["context"] == 6
        asked = spark.createDataFrame([("a", json.dumps({"minutes": rows[:8]}), f"{base}/v1/predict"), ("b", None, f"{base}/healthz"), ("c", None, None), ("d", "{}", f"{base}/v1/predict")], "id string, body string, status string")
        found = {r.id: r for r in http.requested(asked.withColumnRenamed("status", "url"), "url", "body").collect()}
        assert [found[k].status for k in "abcd"] == [200, 200, None, 400] and len(json.loads(found["a"].answer)["rows"]) == 2 and found["c"].answer is None


def test_batches_are_posted(spark, tmp_path):
    got = []

    class Receiver(SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["X-Batch"], self.headers["X-Partition"], self.headers["X-Part"], body))
            self.send_response(200 if self.path == "/ok" else 503)
            self.send_header("Content-Length", "0")
            self.end_headers()

    batch = spark.range(0, 50, 1, 3).select("id", F.when(F.col("id") % 2 == 0, "é").alias("x"))
    with running(ThreadingHTTPServer(("127.0.0.1", 0), Receiver)) as base:
        http.post_sink(f"{base}/ok", rows=7)(batch, 5)
        assert sorted(r["id"] for g in got for r in g[3]) == list(range(50)) and {g[0] for g in got} == {"5"} and max(len(g[3]) for g in got) == 7
        assert len({g[:3] for g in got}) == len(got) and all(r.get("x") == ("é" if r["id"] % 2 == 0 else None) for g in got for r in g[3])
        with pytest.raises(Exception, match="503"):
            http.post_sink(f"{base}/no")(batch, 6)
