"""Evaluation of classifiers: confusion, F1, ensembles, ranking metrics, weights and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import maths

from .ordered import cumulative


def confusion(df: DataFrame, classes: int, keys: tuple[str, ...] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """(keys, label, pred, n) of all classes by classes, cells without rows included. The classes are a fixed few."""
    n = df.groupBy(*keys, label, pred).agg(F.count("*").alias("c"))
    spark = df.sparkSession
    cells = spark.range(classes).select(F.col("id").cast("int").alias(label)).crossJoin(spark.range(classes).select(F.col("id").cast("int").alias(pred)))
    base = df.select(*keys).distinct().crossJoin(cells) if keys else cells
    return base.join(n, [*keys, label, pred], "left").select(*keys, label, pred, F.coalesce("c", F.lit(0)).alias("n"))


def per_class(cells: DataFrame, keys: tuple[str, ...] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """(keys, k, tp, support, predicted, precision, recall, f1) from a confusion table; 0 on empty denominators."""
    k = F.explode(F.array_distinct(F.array(label, pred)))
    rows = cells.select(*keys, label, pred, "n", k.alias("k"))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = rows.groupBy(*keys, "k").agg(hit((F.col(label) == F.col("k")) & (F.col(pred) == F.col("k"))).alias("tp"), hit(F.col(label) == F.col("k")).alias("support"), hit(F.col(pred) == F.col("k")).alias("predicted"))
    out = out.withColumn("precision", maths.div0(F.col("tp"), F.col("predicted"))).withColumn("recall", maths.div0(F.col("tp"), F.col("support")))
    return out.withColumn("f1", maths.f1(F.col("precision"), F.col("recall")))


def summary(classes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro F1 over all classes and F1 weighted by support."""
    n = F.sum("support")
    return classes.groupBy(*keys).agg(n.alias("n"), maths.div0(F.sum("tp"), n).alias("accuracy"), F.avg("f1").alias("macro_f1"), maths.div0(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def mean_probabilities(probs: DataFrame, keys: list[str], p: str = "p", label: str = "label") -> DataFrame:
    """The mean of probability arrays per key, its argmax, and whether the key's labels agree."""
    long = probs.select(*keys, label, F.posexplode(p).alias("k", "q")).groupBy(*keys, "k").agg(F.avg("q").alias("q"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    out = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("s"), F.min("lo").alias(label), (F.min("lo") == F.max("hi")).alias("single_label"))
    return out.select(*keys, label, "single_label", F.col("s.q").alias("p")).withColumn("pred", maths.argmax(F.col("p")).cast("int"))


def auc_roc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve with average ranks of ties, from running counts by score."""
    per = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    won = cumulative(per, score, ["q"]).select("p", "q", (F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("u"))
    return won.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")).alias("auc"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """Step integral of precision over recall, ties as one step, from running counts by score."""
    per = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count("*").alias("n"))
    steps = cumulative(per, score, ["p", "n"]).select("p", (F.col("all_p") - F.col("before_p")).alias("tp"), (F.col("all_n") - F.col("before_n")).alias("all"))
    return steps.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p")).alias("average_precision"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * n_k) per class."""
    c = df.groupBy(label).agg(F.count("*").alias("n_k"))
    all_ = c.agg(F.sum("n_k").alias("n"), F.count("*").alias("classes"))
    return c.crossJoin(F.broadcast(all_)).select(label, "n_k", (F.col("n") / (F.col("classes") * F.col("n_k"))).alias("weight"))


def numbered(df: DataFrame, key: str, name: str = "at") -> DataFrame:
    """``df``, whose ``key`` is a number that doesn't repeat, with each row's place in its order, from 0."""
    return cumulative(df.withColumn("_one", F.lit(1)), key, ["_one"]).withColumn(name, F.col("before__one").cast("long")).drop("_one", "before__one", "all__one")


def hashed_draw(parts: list[Column], n: Column) -> Column:
    """A whole number below ``n``, from 60 bits of a digest of the parts: the same at every run and on every engine with MD5, for any ``n`` up to 2^59."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long"), n)


def draws(n: DataFrame, rounds: int, seed: int, block: int = 1) -> DataFrame:
    """(b, i, at): ``rounds`` moving-block resamples with replacement, each of as many rows as ``n`` (a row with a column n) says.

    A round draws ceil(n / block) starts among the n - block + 1 blocks, puts the blocks together and cuts them to n; a block of 1
    draws single rows. The rounds are dealt to all tasks, and a round's rows are made in stretches, so no array grows with n.
    """
    spark = n.sparkSession
    some = F.broadcast(n.select(F.col("n").cast("long").alias("n")).where("n > 0"))
    b = spark.range(1, rounds + 1, 1, min(rounds, 64)).withColumnRenamed("id", "b").crossJoin(some)
    size = 4096 * block
    b = b.select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("from"))
    b = b.select("b", "n", F.explode(F.sequence("from", F.least(F.col("from") + size, F.col("n")) - 1)).alias("i"))
    start = hashed_draw([F.lit(seed), F.col("b"), F.floor(F.col("i") / block)], F.greatest(F.col("n") - (block - 1), F.lit(1)))
    return b.select("b", "i", (start + F.pmod(F.col("i"), F.lit(block))).alias("at"))
