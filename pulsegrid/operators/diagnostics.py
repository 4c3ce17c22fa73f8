"""Diagnostics of series and thresholds: effective sample size, extreme-value thresholds, case vectors, declared masks, stable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import stored

from .classify import numbered


def percentile_rank(n: Column, p: Column) -> list[Column]:
    """What a linear percentile of ``n`` values rests on: its position from 0, the ranks of both neighbours from below and from the top (from 1), and the upper one's weight."""
    h = (n - 1) * p / 100
    lo, hi = F.floor(h), F.ceil(h)
    return [h.alias("position"), (lo + 1).alias("lower_rank"), (hi + 1).alias("upper_rank"), (n - lo).alias("lower_from_top"), (n - hi).alias("upper_from_top"), (h - lo).alias("weight_on_upper")]


def effective_sample_size(df: DataFrame, order: str, x: str, block: int = 16) -> DataFrame:
    """One row (n, lags, ess): n / (1 + 2 * the autocorrelations before the first that isn't positive), lags up to a quarter of n.

    ``order`` is a number that doesn't repeat. Lags are tried ``block`` at a time, each block one distributed join, and no more blocks
    than needed; the driver gets a row per lag. An empty series has no row.
    """
    spark = df.sparkSession
    n, mean = df.agg(F.count(x), F.avg(x)).first()
    if not n:
        return spark.createDataFrame([], "n long, lags long, ess double")
    base = numbered(df.select(order, (F.col(x) - mean).alias("x")), order).select("at", "x")
    whole = base.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    good: list[float] = []
    for first in range(1, n // 4 + 1, block):
        last = min(first + block - 1, n // 4)
        later = base.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lag"), "at", F.col("x").alias("y")).select("lag", (F.col("at") - F.col("lag")).alias("at"), "y")
        found = {r.lag: r.s / whole if whole else 0.0 for r in base.join(later, "at").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()}
        for lag in range(first, last + 1):
            if found.get(lag, 0.0) <= 0:
                break
            good.append(found[lag])
        if len(good) < last:
            break
    return spark.createDataFrame([(n, len(good), n / (1 + 2 * sum(good)))], "n long, lags long, ess double")


#: Passes over the shapes of a tail: (width of a step, steps to either side of the best place so far), in places of 1/4000.
TAIL_PASSES = ((400, 30), (20, 20), (1, 20))


def tail_threshold(df: DataFrame, keys: list[str], x: str, level: float = 0.98, risk: float = 1e-3, least: int = 10) -> DataFrame:
    """(keys, n, start, n_over, gamma, sigma, threshold, fallback): the value that a share of ``risk`` exceeds, by a generalised Pareto tail.

    The tail begins at the ``level`` quantile and is fitted to the excesses by maximum likelihood. For a given ratio of shape to scale
    the likeliest shape is a mean of logarithms, so only the ratio is searched: three passes over the stored excesses, each a grouped
    mean over a grid around the best place so far. Ratios go from -0.999 of the largest excess's inverse to 999 of the mean's; those
    whose likeliest shape is below -1/2 aren't taken, as the likelihood need have no maximum there. With fewer than ``least`` excesses, or equal ones, the threshold is the
    plain percentile. Null keys are a group; null values count for nothing.
    """
    rows = df.select(F.struct(*keys).alias("k"), F.col(x).cast("double").alias("x"))
    start = stored(rows.groupBy("k").agg(F.count("x").alias("n"), F.percentile("x", F.array(F.lit(level), F.lit(1 - risk))).alias("q")), "tail-start")
    over = stored(rows.join(start, "k").where(F.col("x") > F.col("q")[0]).select("k", (F.col("x") - F.col("q")[0]).alias("y")), "tail")
    e = over.groupBy("k").agg(F.count("y").alias("n_over"), F.avg("y").alias("m"), F.max("y").alias("top"), F.min("y").alias("low"))
    best = e.where((F.col("n_over") >= least) & (F.col("top") > F.col("low"))).select("k", "m", "top", F.lit(0).alias("place"))

    def ratio(place: Column) -> Column:
        u = F.pow(F.lit(10.0), F.abs(place) / 4000)
        return F.when(place < 0, (1 / u - 1) / F.col("top")).otherwise((u - 1) / F.col("m"))

    for width, steps in TAIL_PASSES:
        reach = F.lit(steps * width)
        places = F.sequence(F.col("place") - reach, F.col("place") + reach, F.lit(width))
        grid = best.select("k", "m", "top", F.transform(places, lambda p: F.struct(p.alias("place"), ratio(p).alias("ratio"))).alias("grid"))
        tried = over.join(grid, "k").select("k", "m", "top", "y", F.inline("grid")).groupBy("k", "m", "top", "place", "ratio").agg(F.avg(F.ln(1 + F.col("ratio") * F.col("y"))).alias("gamma"))
        tried = tried.withColumn("sigma", F.when(F.col("place") == 0, F.col("m")).otherwise(F.try_divide("gamma", "ratio")))
        fit = F.when((F.col("place") == 0) | (F.col("gamma") >= -0.5), -F.ln("sigma") - F.col("gamma") - 1)
        best = tried.groupBy("k", "m", "top").agg(F.max(F.struct(fit.alias("fit"), (-F.col("place")).alias("less"), "gamma", "sigma")).alias("b"))
        best = best.select("k", "m", "top", (-F.col("b.less")).alias("place"), "b.gamma", "b.sigma")
    out = start.join(e.select("k", "n_over"), "k", "left").join(best.drop("m", "top"), "k", "left")
    r = F.lit(risk) * F.col("n") / F.col("n_over")
    far = F.when(F.col("place") == 0, -F.col("sigma") * F.ln(r)).otherwise(F.try_divide("sigma", "gamma") * (F.pow(r, -F.col("gamma")) - 1))
    bad = F.col("sigma").isNull()
    threshold = F.when(bad, F.col("q")[1]).otherwise(F.col("q")[0] + far)
    return out.select("k.*", "n", F.col("q")[0].alias("start"), F.coalesce("n_over", F.lit(0)).alias("n_over"), "gamma", "sigma", threshold.alias("threshold"), bad.alias("fallback"))


def case_vectors(rows: DataFrame, keys: list[str], t: str, x: str, minute: int = 60) -> DataFrame:
    """(keys, minutes, mean, sd, max_abs, delta): of the minutes' means, their spread, the largest value of all, and the last mean less the first."""
    per = rows.groupBy(*keys, F.floor(F.col(t) / minute).alias("m")).agg(F.avg(x).alias("v"), F.max(F.abs(x)).alias("p"))
    return per.groupBy(*keys).agg(F.count("*").alias("minutes"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("p").alias("max_abs"), (F.max_by("v", "m") - F.min_by("v", "m")).alias("delta"))


def declared_mask(nodes: DataFrame, channels: DataFrame, rule: list[tuple[str, str | None, dict[str, str]]]) -> DataFrame:
    """(type, modality, nodes, channels, applicable): the entries that a rule declares applicable, counted by node type and modality.

    The rule lists node types (name, prefix of the node's name, modalities); the first whose prefix matches counts, and the last has none.
    A modality maps to the prefix of the channels that apply; one that is missing doesn't apply. ``nodes`` (node) and ``channels``
    (channel, modality) are never crossed: entries are products of counts.
    """
    if not rule or rule[-1][1] is not None or any(p is None for _, p, _ in rule[:-1]):
        raise ValueError("only the last node type is the default")
    kind = F.lit(rule[-1][0])
    for name, prefix, _ in reversed(rule[:-1]):
        kind = F.when(F.col("node").startswith(prefix), name).otherwise(kind)
    per = nodes.groupBy(kind.alias("type")).agg(F.count("*").alias("nodes"))
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(n, m, p) for n, _, ms in rule for m, p in ms.items()], "type string, modality string, prefix string")
    own = channels.join(F.broadcast(wanted), "modality").where(F.col("channel").startswith(F.col("prefix"))).groupBy("type", "modality").agg(F.count("*").alias("channels"))
    return per.join(own, "type").select("type", "modality", "nodes", "channels", (F.col("nodes") * F.col("channels")).alias("applicable"))


def collated(df: DataFrame, optional: list[str]) -> DataFrame:
    """``df`` with its optional whole numbers, -1 where they are absent, and <name>_present: there and at least 0."""
    there = [F.coalesce(F.col(c) >= 0, F.lit(False)).alias(f"{c}_present") for c in optional]
    return df.select(*(F.coalesce(F.col(c), F.lit(-1)).alias(c) if c in optional else F.col(c) for c in df.columns), *there)


def wrapped_ints(values: Column, per_row: int = 16, indent: str = "  ") -> Column:
    """An array of whole numbers as JSON text: on one line, or, with more than ``per_row``, in lines of as many, one level deeper than ``indent``."""
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ", ")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / per_row).cast("int")), lambda r: F.concat(F.lit(f"{indent}  "), text(F.slice(values, r * per_row + 1, per_row))))
    return F.when(F.size(values) <= per_row, F.concat(F.lit("["), text(values), F.lit("]"))).otherwise(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit(f"\n{indent}]")))
