"""Minutes over HTTP: a JSON service whose clients carry the state, documents from servers as rows, and a sink that posts batches."""

from __future__ import annotations

import json
import math
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minutes
from .sinks import Sink

#: Bytes of a request, and minutes in it, at most.
MOST_BYTES, MOST_MINUTES = 64 << 20, 1440


class RequestError(ValueError):
    """A request that can't be answered: a code, the field it is about and a text."""

    def __init__(self, code: str, field: str, message: str):
        super().__init__(message)
        self.body = {"error": {"code": code, "field": field, "message": message}}


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _state(held: object, rule: minutes.Rule) -> dict:
    """The state that a client sends back, checked; a fresh one for null."""
    if held is None:
        return minutes.fresh()
    if not isinstance(held, dict) or set(held) != set(minutes.fresh()):
        raise RequestError("bad_state", "state", "not a state of this service")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    fits = all(held[k] is None or whole(held[k]) for k in ("last", "window")) and (held["score"] is None or _number(held["score"]))
    fits = fits and isinstance(held["recent"], list) and len(held["recent"]) <= rule.context and all(map(_number, held["recent"]))
    fits = fits and (held["open"] is None or isinstance(held["open"], list) and len(held["open"]) == 2 and all(map(whole, held["open"])))
    if not fits:
        raise RequestError("bad_state", "state", "not a state of this service")
    return {**held, "recent": list(held["recent"]), "open": held["open"] and list(held["open"])}


def predict(body: object, rule: minutes.Rule) -> dict:
    """The rows and the new state of {"minutes": [[t, value], ...], "state": the last answer's state or null}.

    Minutes are strictly consecutive and on the step's grid; a segment that doesn't follow the state's last minute begins another, one
    that repeats it is refused. An open incident is among the rows, with ``may_continue``.
    """
    if not isinstance(body, dict):
        raise RequestError("bad_request", "$", "a JSON object is expected")
    rows = body.get("minutes")
    if not isinstance(rows, list) or not rows:
        raise RequestError("bad_minutes", "minutes", "a list of [t, value] is expected")
    if len(rows) > MOST_MINUTES:
        raise RequestError("too_many_minutes", "minutes", f"at most {MOST_MINUTES} at a time")
    for k, r in enumerate(rows):
        if not (isinstance(r, list) and len(r) == 2 and isinstance(r[0], int) and not isinstance(r[0], bool) and _number(r[1])):
            raise RequestError("bad_minute", f"minutes[{k}]", "[t, value] with whole seconds and a finite number is expected")
        if r[0] % rule.step:
            raise RequestError("off_grid", f"minutes[{k}]", f"t is no multiple of {rule.step}")
        if k and r[0] != rows[k - 1][0] + rule.step:
            raise RequestError("not_consecutive", f"minutes[{k}]", f"t is not {rule.step} s after the one before")
    state = _state(body.get("state"), rule)
    if state["last"] is not None and rows[0][0] <= state["last"]:
        raise RequestError("not_after_last", "minutes[0]", "the state's last minute isn't before t")
    names = minutes.COLUMNS[1:]
    out = [dict(zip(names, r, strict=True)) for r in minutes.step(state, [(t, float(v)) for t, v in rows], rule)]
    if state["open"] and state["open"][0] < state["open"][1]:
        first, last = state["open"]
        out.append(dict.fromkeys(names) | {"kind": "incident", "code": "open", "t": first, "end_t": last, "may_continue": last == state["window"]})
    return {"rows": out, "state": state}


def serve(rule: minutes.Rule, host: str = "127.0.0.1", port: int = 0, name: str = "minutes") -> ThreadingHTTPServer:
    """A server of GET /healthz, GET /v1/metadata and POST /v1/predict, not yet started (``serve_forever``); port 0 takes a free one.

    All answers are JSON; errors have a code, a field and a message, never a traceback.
    """
    lock, known = threading.Lock(), ("/healthz", "/v1/metadata", "/v1/predict")

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def refuse(self, status: int, code: str, field: str, message: str) -> None:
            self.close_connection = True
            self.answer(status, RequestError(code, field, message).body)

        def other(self) -> None:
            if self.path in known:
                self.refuse(405, "method_not_allowed", "$", "POST for /v1/predict, else GET")
            else:
                self.refuse(404, "not_found", "$", f"no {self.path}")

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self.answer(200, {"status": "ok", "name": name})
            elif self.path == "/v1/metadata":
                self.answer(200, {"name": name, "rule": rule._asdict(), "columns": minutes.COLUMNS[1:], "most_minutes": MOST_MINUTES})
            else:
                self.other()

        def do_POST(self) -> None:
            if self.path != "/v1/predict":
                return self.other()
            length = self.headers.get("Content-Length") or ""
            if "application/json" not in (self.headers.get("Content-Type") or ""):
                return self.refuse(415, "unsupported_media_type", "Content-Type", "application/json is expected")
            if not length.isdigit():
                return self.refuse(411, "length_required", "Content-Length", "a number is expected")
            if int(length) > MOST_BYTES:
                return self.refuse(413, "body_too_large", "$", f"at most {MOST_BYTES} bytes")
            try:
                body = json.loads(self.rfile.read(int(length)))
            except ValueError as e:
                return self.refuse(400, "invalid_json", "$", str(e))
            try:
                with lock:
                    found = predict(body, rule)
            except RequestError as e:
                return self.answer(400, e.body)
            except Exception:  # the client learns no more than this
                return self.refuse(500, "internal_error", "$", "the request failed")
            return self.answer(200, found)

        do_PUT = do_DELETE = do_PATCH = other

    return ThreadingHTTPServer((host, port), Handler)


def call(url: str, body: object = None, headers: dict[str, str] | None = None, timeout: float = 60) -> tuple[int, str]:
    """(status, text) of a request: GET, or POST of ``body`` as JSON. An error's answer is an answer; a server that can't be reached raises."""
    data = None if body is None else json.dumps(body).encode()
    asked = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def requested(rows: DataFrame, url: str, body: str | None = None) -> DataFrame:
    """``rows`` and each one's status and answer: a GET of its ``url``, or a POST of the JSON text in ``body`` where that isn't null.

    Executors ask, a row at a time; a repeated task asks again. A null url isn't asked and has null results. ``status`` and ``answer``
    replace columns of these names.
    """

    @F.pandas_udf("status int, answer string")
    def ask(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        got = [(None, None) if u is None else call(u, None if b is None else json.loads(b)) for u, b in zip(urls, bodies, strict=True)]
        return pd.DataFrame(got, columns=["status", "answer"]).astype({"status": "Int32"})

    text: Column = F.col(body) if body else F.lit(None).cast("string")
    kept = rows.select(*(c for c in rows.columns if c not in ("status", "answer")))
    return kept.withColumn("_asked", ask(F.col(url), text)).select(*kept.columns, "_asked.status", "_asked.answer")


def post_sink(url: str, rows: int = 1000, send: Callable[..., tuple[int, str]] = call) -> Sink:
    """A sink for ``fan_out`` that posts a batch's rows as JSON lists, from the executors. Each request says which batch, partition and part it is of, so that a receiver can tell repeats."""

    def put(batch: DataFrame, number: int) -> None:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part, task = 0, TaskContext.get().partitionId()
            for pdf in frames:
                for first in range(0, len(pdf), rows):
                    found = [json.loads(x) for x in pdf["row"][first : first + rows]]
                    status, text = send(url, found, {"X-Batch": str(number), "X-Partition": str(task), "X-Part": str(part)})
                    if status >= 300:
                        raise OSError(f"{url}: {status} {text[:200]}")
                    part += 1
                yield pd.DataFrame({"n": [len(pdf)]})

        batch.select(F.to_json(F.struct("*")).alias("row")).mapInPandas(run, "n long").agg(F.sum("n")).first()

    return put
