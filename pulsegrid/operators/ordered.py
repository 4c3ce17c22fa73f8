"""Running sums and exact quantiles over all rows in the order of a number, from counts by value, without one window over all values.

Values are dealt to shards by sign and logarithm, 256 to each doubling, which keeps their order and needs no look at the data. A
shard is a window partition; a table with a row per shard carries the sums of the shards before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shards to each doubling of a value.
PER_DOUBLING = 256


def shard_of(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises: 0 for 0, mirrored for values below 0."""
    x = x.cast("double")
    step = F.floor((F.least(F.log2(F.abs(x)), F.lit(1025.0)) + 1080) * PER_DOUBLING) + 1  # infinity has the last
    return F.when(x == 0, F.lit(0)).when(x > 0, step).otherwise(-step).cast("long")


def cumulative(counts: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """``counts``, which has a row per ``value``, with before_<c> and all_<c> of each column: its sum over smaller values, and over all.

    Null and NaN values are left out. An empty table stays empty.
    """
    df = counts.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_shard", shard_of(F.col(value)))
    every = W.partitionBy(F.lit(0)).orderBy("_shard")
    ahead, whole = every.rowsBetween(W.unboundedPreceding, -1), every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = df.groupBy("_shard").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    per = per.select("_shard", *(F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_first_{c}") for c in columns), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in columns))
    inside = W.partitionBy("_shard").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    df = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in columns)).join(per, "_shard")
    return df.select(*counts.columns, *((F.col(f"_first_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in columns), *(f"all_{c}" for c in columns))


def grid_quantiles(counts: DataFrame, value: str, n: str, steps: int) -> DataFrame:
    """(k, tau, upto, n) for k = 0 to ``steps``: the quantile k / steps by linear interpolation, how many values are at most its lower neighbour, and their number.

    Every value finds the quantiles that have it as a neighbour by arithmetic on its running count, so nothing is joined.
    """
    c = cumulative(counts.where(F.col(n) > 0), value, [n])
    before, upto, top = F.col(f"before_{n}"), F.col(f"before_{n}") + F.col(n), F.col(f"all_{n}") - 1
    # the place of quantile k is top * k / steps; candidates from a little before the first to a little after the last are tested exactly
    first = F.when(top > 0, F.greatest(F.lit(0), F.floor((before - 1) * steps / top) - 1)).otherwise(0)
    last = F.when(top > 0, F.least(F.lit(steps), F.ceil(upto * steps / top) + 1)).otherwise(steps)
    c = c.select(F.col(value).cast("double").alias("x"), before.alias("before"), upto.alias("upto"), top.alias("top"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("k"))
    place, rest = F.expr(f"(top * k) div {steps}"), F.expr(f"(top * k) % {steps}")
    c = c.select("x", "upto", "top", "k", rest.alias("rest"), ((place >= F.col("before")) & (place < F.col("upto"))).alias("low"), ((place + (rest > 0).cast("long") >= F.col("before")) & (place + (rest > 0).cast("long") < F.col("upto"))).alias("high"))
    both = c.where("low or high").groupBy("k", "rest", "top").agg(F.max(F.when(F.col("low"), F.col("x"))).alias("a"), F.max(F.when(F.col("high"), F.col("x"))).alias("b"), F.max(F.when(F.col("low"), F.col("upto"))).alias("upto"))
    return both.select("k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("rest") / steps).alias("tau"), "upto", (F.col("top") + 1).alias("n"))
