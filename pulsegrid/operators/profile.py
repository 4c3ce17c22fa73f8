"""Profiles of features: moments, histograms, correlations, shifts; and standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import cumulative


def moments(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Mean, population spread, range, share of zeros and constancy per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg((F.col(v) == 0).cast("double")).alias("zero_fraction"), (F.min(v) == F.max(v)).alias("constant")
    )


def fit_scaler(df: DataFrame, keys: list[str], v: str = "v", floor: float = 1e-8, sample: bool = False) -> DataFrame:
    """(keys, mean, scale): spreads below ``floor`` become 1 (population form) or ``floor`` (sample form); NaN and null are skipped."""
    x = F.when(~F.isnan(v), F.col(v))
    std = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), std.alias("std")).select(*keys, "mean", (F.greatest("std", F.lit(floor)) if sample else F.when(F.col("std") < floor, 1.0).otherwise(F.col("std"))).alias("scale"))


def transform(df: DataFrame, scaler: DataFrame, keys: list[str], absent: DataFrame | None = None, v: str = "v") -> DataFrame:
    """Adds z, the standardised value; keys in ``absent`` have 0. The scaler has a row per key; Spark broadcasts it while it is small."""
    out = df.join(scaler, keys)
    z = (F.col(v) - F.col("mean")) / F.col("scale")
    if absent is not None:
        out = out.join(absent.select(*keys, F.lit(True).alias("_absent")), keys, "left")
        z = F.when(F.col("_absent"), 0.0).otherwise(z)
    return out.withColumn("z", z).drop("_absent", "mean", "scale")


def structural_absence(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Keys whose every value is zero: a property of the whole block, not of a value."""
    return df.groupBy(*keys).agg(F.every(F.col(v) == 0).alias("absent"))


def histogram(df: DataFrame, v: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, lo_edge, hi_edge, n) of clipped values, empty bins included. A value belongs to the bin whose edges hold it, the last one closed.

    The arithmetic bin is corrected by comparison with the edges, which are lo + k * width.
    """
    width = (hi - lo) / bins
    x = F.least(F.greatest(F.col(v), F.lit(lo)), F.lit(hi))
    edge = lambda k: F.lit(lo) + k * F.lit(width)
    g = F.floor((x - lo) / width)
    k = F.when(x >= edge(g + 1), g + 1).when(x < edge(g), g - 1).otherwise(g)
    n = df.select(F.least(k, F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("c"))
    base = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return base.join(n, "bin", "left").select("bin", edge(F.col("bin")).alias("lo_edge"), edge(F.col("bin") + 1).alias("hi_edge"), F.coalesce("c", F.lit(0)).alias("n"))


def correlations(df: DataFrame, row: str, col: str, v: str, floor: float = 1e-9) -> DataFrame:
    """(i, j, r) of all ordered pairs i < j of the columns of a long table; columns with a spread up to ``floor`` are left out.

    Values are gathered per row (as many as there are columns) and paired inside it, so the only shuffle is by pair.
    """
    live = df.groupBy(col).agg(F.stddev_pop(v).alias("s")).where(F.col("s") > floor).select(col)
    rows = df.join(live, col).groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), F.col(v).alias("x")))).alias("a"))
    pairs = rows.select(F.posexplode("a").alias("p", "l"), "a").select("l", F.explode(F.slice("a", F.col("p") + 2, F.size("a"))).alias("m"))
    return pairs.groupBy(F.col("l.c").alias("i"), F.col("m.c").alias("j")).agg(F.corr("l.x", "m.x").alias("r"))


def ks(df: DataFrame, side: str, v: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ks, p_value): the two-sample Kolmogorov-Smirnov statistic between rows with ``side`` true and false, from running counts by value.

    The p-value is the asymptotic one of two sides of a and b rows, the sum over j of 2 (-1)^(j - 1) exp(-2 j^2 x^2) at
    x = ks * sqrt(a b / (a + b)), held between 0 and 1; 1 where x is below 0.2, as the sum is there to 12 places.
    """
    per = df.groupBy(*keys, v).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    if keys:  # a window for each key holds its values; for few large keys put the key into the value's shard first
        up, every = W.partitionBy(*keys).orderBy(v).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
        c = per.select(*keys, *((F.sum(x).over(up)).alias(f"up_{x}") for x in "ab"), *((F.sum(x).over(every)).alias(f"all_{x}") for x in "ab"))
    else:
        c = cumulative(per, v, ["a", "b"]).select(*((F.col(f"before_{x}") + F.col(x)).alias(f"up_{x}") for x in "ab"), "all_a", "all_b")
    gap = F.abs(F.try_divide(F.col("up_a"), F.col("all_a")) - F.try_divide(F.col("up_b"), F.col("all_b")))
    out = c.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("all_a").alias("a"), F.max("all_b").alias("b"))
    x = F.col("ks") * F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b")))
    tail = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(2, 41)), F.lit(2.0) * F.exp(-2.0 * x * x))
    return out.select(*keys, "ks", F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).alias("p_value"))
