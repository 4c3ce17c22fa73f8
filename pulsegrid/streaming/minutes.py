"""The minute stream: strictly consecutive steps per entity become 6+1 windows, rolling maxima, alerts and incidents, with state between batches.

A row is scored when the ``context`` steps right before it are there: its score is the distance from their mean. A gap begins another
segment, whose first rows are context only; windows and rolling maxima never bridge it. A row off the step's grid, or not after the last
one, is rejected with a code. Rows with a value beyond ``limit`` are kept and a warning is given out.

State per entity: the last step, the context, the last window's score, and the open incident. An incident closes when a window comes at
least ``gap`` seconds after its last alert; one of a single alert is dropped, as in batch. One that is still open is in the state
only, where ``open_incidents`` reads it once the stream has ended.

Rows carry ``kind``: window, incident, rejected or warning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity string, kind string, code string, t long, end_t long, score double, rolled double, alert boolean"
COLUMNS = ["entity", "kind", "code", "t", "end_t", "score", "rolled", "alert"]


class Rule(NamedTuple):
    """Seconds of a step, steps of context, score from which (strictly) a window alerts, seconds that part incidents, and the largest usual value."""

    threshold: float
    step: int = 60
    context: int = 6
    gap: int = 600
    limit: float = 50.0


def fresh() -> dict:
    return {"last": None, "recent": [], "score": None, "open": None, "window": None}


def step(state: dict, rows: list[tuple[int, float]], rule: Rule) -> list[tuple]:
    """Applies sorted (t, value) rows to a state in place: the rows to give out, without the entity."""
    out = []
    for t, value in rows:
        if t % rule.step:
            out.append(("rejected", "off_grid", t, None, value, None, None))
            continue
        if state["last"] is not None and t <= state["last"]:
            out.append(("rejected", "not_after_last", t, None, value, None, None))
            continue
        if state["last"] is not None and t != state["last"] + rule.step:
            state["recent"], state["score"] = [], None
        state["last"] = t
        if abs(value) > rule.limit:
            out.append(("warning", "out_of_range", t, None, value, None, None))
        if len(state["recent"]) == rule.context:
            score = abs(value - sum(state["recent"]) / rule.context)
            rolled = max(score, state["score"]) if state["score"] is not None else score
            state["score"], state["window"] = score, t
            if state["open"] and t - state["open"][1] >= rule.gap:
                first, last = state["open"]
                if first < last:
                    out.append(("incident", "closed", first, last, None, None, None))
                state["open"] = None
            if rolled > rule.threshold:
                state["open"] = [state["open"][0] if state["open"] else t, t]
            out.append(("window", None, t, None, score, rolled, rolled > rule.threshold))
        state["recent"] = (state["recent"] + [value])[-rule.context :]
    return out


def minute_alerts(stream: DataFrame, rule: Rule) -> DataFrame:
    """``stream`` has entity, t (epoch seconds) and value; works on a streaming frame. Rows without t or value are dropped.

    A batch's rows of one entity are sorted in one task, so a replay is cut in slices of time, and a busy entity is dealt to several.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else fresh()
        rows = sorted((int(t), float(v)) for pdf in batches for t, v in zip(pdf["t"], pdf["value"], strict=True))
        out = step(held, rows, rule)
        state.update((json.dumps(held),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=COLUMNS).astype({"t": "Int64", "end_t": "Int64", "score": "Float64", "rolled": "Float64", "alert": "boolean"})

    clean = stream.select("entity", "t", "value").where("t is not null and value is not null")
    return clean.groupBy("entity").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def open_incidents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The incidents that the stream of ``minute_alerts`` with this checkpoint left open, in its columns and ``may_continue``: whether the last window is an alert.

    One of a single alert is dropped, as are closed ones.
    """
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.entity").alias("entity"), F.from_json("value.groupState.state", "window long, open array<long>").alias("s"))
    first, last = F.col("s.open")[0], F.col("s.open")[1]
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("score", "double"), ("rolled", "double"), ("alert", "boolean"))]
    return held.where(first < last).select("entity", F.lit("incident").alias("kind"), F.lit("open").alias("code"), first.alias("t"), last.alias("end_t"), *none, (last == F.col("s.window")).alias("may_continue"))


def slices(rows: DataFrame, path: str, t: str, seconds: int) -> DataFrame:
    """Stores ``rows`` for a replay: files of ``seconds`` of time each, written one after another, so their times of change are in order. Returns the schema's empty frame.

    The slices come from the range of ``t``, which is all that the driver learns.
    """
    lo, hi = rows.agg(F.min(t), F.max(t)).first()
    for start in range(lo, hi + 1, seconds) if lo is not None else ():
        rows.where((F.col(t) >= start) & (F.col(t) < start + seconds)).coalesce(1).write.mode("append").parquet(path)
    return rows.limit(0)


def replay(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Stored minutes as a stream, some files at a time in the order of their times of change."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_end(out: DataFrame, folder: str) -> DataFrame:
    """Runs a stream to the end of its source, rows to files and state to a checkpoint, both below ``folder``; the rows, with ``may_continue``, and incidents still open."""
    spark = out.sparkSession
    run = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = spark.read.schema(OUT).parquet(f"{folder}/rows").withColumn("may_continue", F.when(F.col("kind") == "incident", False))
    return closed.unionByName(open_incidents(spark, f"{folder}/state"))


def tumbling(stream: DataFrame, late: str = "660 seconds", size: str = "10 minutes") -> DataFrame:
    """Counts and means per window of a stream with a ``ts`` timestamp; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "entity").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
