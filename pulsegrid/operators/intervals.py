"""Operators on time: previous rows, islands, range joins, nearest joins and merged episodes.

Rows without a key are ordered globally in shards of ``SHARD`` seconds: each shard is a window partition, and a table with a row per
shard carries what crosses its edges. No global window ever holds more than that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a shard: one task holds the rows of one.
SHARD = 3_600


def _carry(df: DataFrame, keys: list[str], value: Column, name: str, how) -> DataFrame:
    """A row per (keys, shard) with the running ``how`` of ``value`` over the shards before it."""
    per = df.groupBy(*keys, "shard").agg(value.alias("_v"))
    over = W.partitionBy(*(keys or [F.lit(0)])).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return per.select(*keys, "shard", how("_v").over(over).alias(name))


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, [*keys, "shard"], "left")


def with_previous(df: DataFrame, t: str = "t", order: tuple[str, ...] = ("t",), keys: list[str] | None = None, name: str = "prev", shard: int = SHARD) -> DataFrame:
    """Adds the value of ``t`` in the row before, null in the first row (of each key)."""
    keys = keys or []
    df = df.withColumn("shard", F.floor(F.col(t) / shard))
    last = _carry(df, keys, F.max(t), "_last", F.max)
    inside = F.lag(t).over(W.partitionBy(*keys, "shard").orderBy(*order))
    return _joined(df.withColumn("_lag", inside), last, keys).withColumn(name, F.coalesce("_lag", "_last")).drop("_lag", "_last", "shard")


def with_running(df: DataFrame, value: Column, order: tuple[str, ...], name: str, t: str = "t", keys: list[str] | None = None, shard: int = SHARD, how=F.sum, rest=lambda a, b: a + b) -> DataFrame:
    """Adds the running ``how`` of ``value`` up to and with each row; ``rest`` puts the shards before and the own shard together."""
    keys = keys or []
    df = df.withColumn("shard", F.floor(F.col(t) / shard)).withColumn("_x", value)
    before = _carry(df, keys, how("_x"), "_before", how)
    inside = how("_x").over(W.partitionBy(*keys, "shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = _joined(df.withColumn("_in", inside), before, keys)
    return out.withColumn(name, F.when(F.col("_before").isNull(), F.col("_in")).otherwise(rest(F.col("_before"), F.col("_in")))).drop("_in", "_before", "_x", "shard")


def island_spans(df: DataFrame, breaks, t: str = "t", keys: list[str] | None = None, shard: int = SHARD) -> DataFrame:
    """(keys, start_t, end_t, n) of runs of rows: a new one begins where ``breaks(gap)`` holds, gap being the step from the row before.

    The table is read and shuffled once. Runs are found in each shard; only the first of a shard can go on from an earlier one, and only
    the last can be gone on from, so these, two rows a shard at most, are all that meets in one window (of each key).
    """
    keys = keys or []
    df = df.select(*keys, F.col(t).alias("_t"), F.floor(F.col(t) / shard).alias("_s"))
    w = W.partitionBy(*keys, "_s").orderBy("_t")
    df = df.withColumn("_new", F.when(breaks(F.col("_t") - F.lag("_t").over(w)), 1).otherwise(0))
    df = df.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = df.groupBy(*keys, "_s", "_i").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n"))
    edge = (F.col("_i") == 0) | (F.col("_i") == F.max("_i").over(W.partitionBy(*keys, "_s")))
    part = part.withColumn("_p", F.when(~edge, F.col("_s")))
    w = W.partitionBy(*keys, "_p").orderBy("_lo", "_i")
    part = part.withColumn("_last", F.lag("_hi").over(w))
    goes_on = (F.col("_i") == 0) & F.col("_last").isNotNull() & ~breaks(F.col("_lo") - F.col("_last"))
    part = part.withColumn("_g", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_p", "_g").agg(F.min("_lo").alias("start_t"), F.max("_hi").alias("end_t"), F.sum("_n").alias("n")).drop("_p", "_g")


def alert_groups(alerts: DataFrame, gap: int = 600, t: str = "t") -> DataFrame:
    """(start_t, end_t, n) of alerts closer than ``gap``; a step of ``gap`` or more begins another group."""
    return island_spans(alerts, lambda g: g >= gap, t)


def alert_intervals(alerts: DataFrame, gap: int = 600, t: str = "t") -> DataFrame:
    """(start_t, end_t), each once; groups of a single moment are dropped."""
    return alert_groups(alerts, gap, t).where("start_t < end_t").select("start_t", "end_t")


def bucket_join(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the closed spans that hold them, as an equi-join on time buckets; spans go to each bucket they touch.

    ``how`` is a join type; a span that no point is in comes once for each of its buckets in outer joins. ``width`` near the spans' usual length keeps the copies few.
    """
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("_b", F.floor(F.col(t) / width)).alias("p")
    s = cut.withColumnRenamed("_b", "_c").alias("s")
    return p.join(s, (F.col("_b") == F.col("_c")) & (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi)), how).drop("_b", "_c")


def nearest(left: DataFrame, right: DataFrame, t: str, rt: str, tolerance: int) -> DataFrame:
    """Each left row with the nearest right time within ``tolerance`` (closed), the earlier of equally near ones; null without any.

    Right times go to the bucket of their own and both beside it, so the join is on equality. ``left`` has a unique ``_id``.
    """
    r = right.select(F.col(rt).alias("near")).distinct().withColumn("_b", F.explode(F.array(*[F.floor(F.col("near") / tolerance) + k for k in (-1, 0, 1)])))
    hit = left.withColumn("_b", F.floor(F.col(t) / tolerance)).join(r, "_b").where(F.abs(F.col(t) - F.col("near")) <= tolerance)
    best = hit.groupBy("_id").agg(F.min(F.struct(F.abs(F.col(t) - F.col("near")).alias("d"), F.col("near").alias("near"))).alias("best"))
    return left.join(best, "_id", "left").select(*left.columns, F.col("best.near").alias("near"), F.col("best.d").alias("distance"))


def nearest_any(left: DataFrame, right: DataFrame, t: str, rt: str) -> DataFrame:
    """Each left row with the nearest right time at any distance: the last before and the first after, compared. ``left`` has ``_id``."""
    both = left.select("_id", F.col(t).alias("x"), F.lit(None).cast("long").alias("r")).union(right.select(F.lit(None).cast("long"), F.col(rt), F.col(rt)))
    both = with_running(both, F.col("r"), ("x", F.col("r").isNull()), "before", "x", how=F.max, rest=F.greatest)
    flipped = with_running(both.withColumn("y", -F.col("x")), F.col("r"), ("y", F.col("r").isNull()), "after", "y", how=F.min, rest=F.least)
    pick = F.when(F.col("after").isNull() | (F.col("x") - F.col("before") <= F.col("after") - F.col("x")), F.col("before")).otherwise(F.col("after"))
    best = flipped.where("_id is not null").select("_id", pick.alias("near"))
    return left.join(best, "_id", "left").withColumn("distance", F.abs(F.col(t) - F.col("near")))


def episodes(spans: DataFrame, lo: str, hi: str, shard: int = SHARD) -> DataFrame:
    """(start_t, end_t, n) of merged spans that overlap or touch: a new one begins after the largest end so far.

    Spans are merged in the shard where they begin; what is left, which doesn't overlap in its shard, is told the largest end, and
    then the last beginning, of the shards before it.
    """
    s = spans.select(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.floor(F.col(lo) / shard).alias("shard"))
    w = W.partitionBy("shard").orderBy("lo", "hi")
    s = s.withColumn("_top", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_i", F.sum(F.when(F.col("_top").isNull() | (F.col("lo") > F.col("_top")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = s.groupBy("shard", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    w = W.partitionBy("shard").orderBy("lo")
    part = part.join(_carry(part, [], F.max("hi"), "_reach", F.max), "shard")
    part = part.withColumn("_new", F.when(F.col("lo") > F.coalesce(F.greatest("_reach", F.lag("hi").over(w)), F.col("lo") - 1), F.col("lo")))
    part = part.join(_carry(part, [], F.max("_new"), "_from", F.max), "shard")
    part = part.withColumn("start_t", F.coalesce(F.max("_new").over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_from")))
    return part.groupBy("start_t").agg(F.max("hi").alias("end_t"), F.sum("n").alias("n"))


def windows(df: DataFrame, length: int, step: int, t: str = "t") -> DataFrame:
    """(start, target) of each run of ``length`` rows whose steps all are ``step``; no window bridges a gap."""
    return strided(df, length, step, 1, t).select("start", (F.col("start") + (length - 1) * step).alias("target"))


def strided(df: DataFrame, length: int, step: int, stride: int, t: str = "t") -> DataFrame:
    """(start) of every ``stride``-th window of each run: a run's rows are known from its ends."""
    run = island_spans(df, lambda g: g != step, t).where(F.col("end_t") - F.col("start_t") >= (length - 1) * step)
    return run.select(F.explode(F.sequence(F.col("start_t"), F.col("end_t") - (length - 1) * step, F.lit(step * stride).cast("long"))).alias("start"))


def rolling_max(df: DataFrame, value: str, width: int, t: str = "t", keys: tuple[str, ...] = (), shard: int = SHARD) -> DataFrame:
    """Adds the maximum over the last ``width`` seconds, with both ends. Rows are copied to the next shard where it reaches back to them."""
    own = F.floor(F.col(t) / shard)
    spread = df.withColumn("shard", F.explode(F.array_distinct(F.array(own, F.floor((F.col(t) + width) / shard))))).withColumn("_own", own)
    over = W.partitionBy(*keys, "shard").orderBy(t).rangeBetween(-width, 0)
    return spread.withColumn("rolled", F.max(value).over(over)).where("shard = _own").drop("shard", "_own")
