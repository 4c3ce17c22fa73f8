"""Alerts of a stream to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


def folder_sink(path: str) -> Sink:
    """Each batch as JSON lines in a folder of its own; a batch that is given again replaces it."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return put


def fan_out(alerts: DataFrame, sinks: Mapping[str, Sink], checkpoint: str, report: Callable[[str, int, str], None] = lambda *_: None) -> StreamingQuery:
    """Starts a stream that gives every batch to all sinks; ``report`` gets (sink, batch, "delivered" or the error).

    A sink that fails doesn't keep the others from the batch, but fails the batch after them, so that it is given again: sinks get the
    batch's number to tell. An empty batch is given to none.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()
        failed = []
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                    report(name, number, "delivered")
                except Exception as e:  # any sink's own error; it is reported, and raised below
                    failed.append(e)
                    report(name, number, f"{type(e).__name__}: {e}")
        finally:
            batch.unpersist()
        if failed:
            raise failed[0]

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
