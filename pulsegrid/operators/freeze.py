"""A frozen state, and a run over the test rows that can be claimed once.

``freeze`` stores an inventory of files. ``claim`` compares it with the files as they are, writes markers and gives a token; where a
marker exists already, it refuses. ``scorable`` gives out test rows only for a token. Markers are made by the file system's create
without overwriting, so two claims at a time can't both succeed where that is atomic (HDFS; not all object stores).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources import files

#: Roles whose rows may always be scored, and the one that takes a token.
OPEN_ROLES, LOCKED = ("calibration", "validation"), "test"


class FreezeError(RuntimeError):
    """The files differ from the frozen ones, the run was claimed before, or a token is missing."""


@dataclass(frozen=True)
class Token:
    """What ``claim`` and ``resume`` give out: the run's id and the digest of the frozen inventory."""

    run_id: str
    digest: str


def digest(record: DataFrame) -> str:
    """A digest of an inventory's paths and contents, whatever the order of its rows."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\n", "path", "sha256"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    row = record.agg(F.count("*").alias("n"), F.sum(part).alias("s")).select(F.sha2(F.concat_ws(":", "n", F.coalesce("s", F.lit(0))), 256))
    return row.first()[0]


def freeze(found: DataFrame, path: str) -> str:
    """Stores an inventory (path, bytes, sha256) as the record at ``path``, which must not exist; its digest."""
    found.select("path", "bytes", "sha256").write.parquet(path)
    return digest(found.sparkSession.read.parquet(path))


def problems(found: DataFrame, path: str, most: int = 8) -> list[str]:
    """What differs between the files and the record, the first ``most`` paths and the number of all; empty if nothing does."""
    off = files.verify_inventory(found, found.sparkSession.read.parquet(path)).where("status <> 'ok'")
    named = [f"{r.status}: {r.path}" for r in off.orderBy("path").limit(most).collect()]
    return [*named, f"{off.count()} files differ"] if named else []


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _marked(spark: SparkSession, path: str) -> dict | None:
    """The marker at ``path``; None without one. One that was left unfinished names no run."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    try:
        return json.loads("".join(r.value for r in spark.read.text(path).collect()))
    except ValueError:
        return {"run_id": None}


def _checked(found: DataFrame, path: str) -> str:
    bad = problems(found, path)
    if bad:
        raise FreezeError("the frozen files have changed: " + "; ".join(bad))
    return digest(found.sparkSession.read.parquet(path))


def claim(found: DataFrame, path: str, markers: Sequence[str]) -> Token:
    """Claims the one run: the record must hold, no marker may exist, and all are written before the token is given out."""
    spark = found.sparkSession
    for m in markers:
        if _marked(spark, m) is not None:
            raise FreezeError(f"the run was claimed before: {m}")
    token = Token(uuid.uuid4().hex, _checked(found, path))
    text = json.dumps({"run_id": token.run_id, "digest": token.digest, "started": int(time.time())})
    for m in markers:
        fs, p = _at(spark, m)
        try:
            out = fs.create(p, False)
        except Exception as e:  # the JVM's own error, of one that came first among others
            raise FreezeError(f"the marker can't be made: {m}") from e
        out.write(bytearray(text.encode()))
        out.close()
    return token


def resume(found: DataFrame, path: str, markers: Sequence[str], run_id: str) -> Token:
    """The token of a run that goes on elsewhere: the record must still hold, and all markers name the run."""
    for m in markers:
        held = _marked(found.sparkSession, m)
        if held is None or not run_id or held["run_id"] != run_id:
            raise FreezeError(f"no marker of this run: {m}")
    return Token(run_id, _checked(found, path))


def scorable(rows: DataFrame, role: str, token: Token | None = None) -> DataFrame:
    """The rows whose role may be scored: the open ones, and with a token the test rows too. Rows without a role are left out."""
    if token is not None and not (isinstance(token, Token) and token.run_id):
        raise FreezeError("the test rows take a token of claim or resume")
    return rows.where(F.col(role).isin(*OPEN_ROLES, *([LOCKED] if token else [])))
