"""Tables kept for as long as their files stay as they are, and results of queries kept for a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a query's result is kept.
TTL = 3600


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(latest time of change, bytes, number) of the files at or below a path; None without it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    found, latest, size, n = fs.listFiles(p, True), 0, 0, 0
    while found.hasNext():
        f = found.next()
        latest, size, n = max(latest, f.getModificationTime()), size + f.getLen(), n + 1
    return latest, size, n


class Cache:
    """Frames that Spark keeps in memory and on disk, let go when they are out of date.

    An entry is computed when it is first used. Executors that are lost take their part with them, which is then read again.
    """

    def __init__(self, spark: SparkSession, ttl: float = TTL, now: Callable[[], float] = time.monotonic):
        self.spark, self.ttl, self.now = spark, ttl, now
        self._held: dict[tuple[str, str], tuple[object, DataFrame]] = {}

    def _keep(self, key: tuple[str, str], mark: object, df: DataFrame) -> DataFrame:
        self.drop(*key)
        self._held[key] = (mark, df.persist())
        return df

    def table(self, path: str, read: Callable[[str], DataFrame] | None = None) -> DataFrame | None:
        """The table at a path (Parquet unless ``read`` says otherwise), read anew once its files have changed; None without it."""
        mark, key = state_of(self.spark, path), ("table", path)
        if mark is None:
            self.drop(*key)
            return None
        if key in self._held and self._held[key][0] == mark:
            return self._held[key][1]
        return self._keep(key, mark, (read or self.spark.read.parquet)(path))

    def query(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A query's result by name, made anew after ``ttl`` seconds."""
        key = ("query", name)
        if key in self._held and self.now() - self._held[key][0] < self.ttl:
            return self._held[key][1]
        return self._keep(key, self.now(), make())

    def drop(self, kind: str, name: str) -> None:
        """Forgets an entry, "table" or "query"; one that isn't there is no error."""
        if (kind, name) in self._held:
            self._held.pop((kind, name))[1].unpersist()

    def clear(self) -> None:
        for key in list(self._held):
            self.drop(*key)
