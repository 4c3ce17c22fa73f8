"""From scores to alerts, intervals and event-level metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import maths

from .intervals import bucket_join
from .ordered import grid_quantiles


def hits(intervals: DataFrame, labels: DataFrame, slack: int = 300) -> DataFrame:
    """Intervals with the labels (t, ...) within ``slack`` of them, both ends closed."""
    spans = intervals.select("start_t", "end_t", (F.col("start_t") - slack).alias("_lo"), (F.col("end_t") + slack).alias("_hi"))
    return bucket_join(labels, spans, "t", "_lo", "_hi", 3600).drop("_lo", "_hi")


def event_metrics(intervals: DataFrame, labels: DataFrame, slack: int = 300) -> DataFrame:
    """One row: TP counts labels that some interval hits, FP intervals without a label; equal labels and intervals count once.

    Precision and recall are rounded half-even to four places and F1 is of the rounded ones; density is the mean number of labels of an
    interval that hits any, to two places. Where nothing can be scored the row has zeros and ``scored`` is false. Intervals and labels
    meet in one full outer join, so each is read once.
    """
    spans = intervals.select("start_t", "end_t", (F.col("start_t") - slack).alias("_lo"), (F.col("end_t") + slack).alias("_hi"))
    span = F.struct("start_t", "end_t")
    j = bucket_join(labels.select("t"), spans, "t", "_lo", "_hi", 3600, "full_outer")
    hit = F.col("t").isNotNull() & F.col("start_t").isNotNull()
    n = lambda c, on: F.count_distinct(F.when(on, c))
    row = j.agg(n(span, F.col("start_t").isNotNull()).alias("n_intervals"), F.count_distinct("t").alias("n_labels"), n(F.col("t"), hit).alias("tp"), n(span, hit).alias("hit"), n(F.struct("t", "start_t", "end_t"), hit).alias("pairs"))
    row = row.withColumn("fp", F.col("n_intervals") - F.col("hit")).withColumn("fn", F.col("n_labels") - F.col("tp"))
    row = row.withColumn("precision", F.bround(maths.div0(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.bround(maths.div0(F.col("tp"), F.col("n_labels")), 4))
    f1 = F.bround(maths.f1(F.col("precision"), F.col("recall")), 4)
    scored = (F.col("n_intervals") > 0) & (F.col("n_labels") > 0) & (F.col("tp") > 0)
    return row.select("n_intervals", "n_labels", "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), F.bround(maths.div0(F.col("pairs"), F.col("hit")), 2).alias("density"), scored.alias("scored"))


def interval_classes(intervals: DataFrame, labels: DataFrame, slack: int, guard: int) -> DataFrame:
    """Each interval's kind: hit, ignore_overlap (within the guard only) or normal_only. ``guard`` is at least ``slack``."""
    spans = intervals.select("start_t", "end_t", (F.col("start_t") - guard).alias("_lo"), (F.col("end_t") + guard).alias("_hi"))
    j = bucket_join(labels.select("t"), spans, "t", "_lo", "_hi", 3600, "right")
    hit = F.col("t").between(F.col("start_t") - slack, F.col("end_t") + slack)
    kind = F.when(F.coalesce(F.bool_or(hit), F.lit(False)), "hit").when(F.count("t") > 0, "ignore_overlap").otherwise("normal_only")
    return j.groupBy("start_t", "end_t").agg(kind.alias("kind"))


def delay_summary(intervals: DataFrame, labels: DataFrame, slack: int = 300) -> DataFrame:
    """From each hit label to the start of the first interval that hits it; nulls where none is hit."""
    d = hits(intervals, labels, slack).groupBy("case_id").agg((F.min("start_t") - F.min("t")).alias("delay"))
    return d.agg(F.count("*").alias("n"), F.percentile("delay", F.lit(0.5)).alias("median_delay"), F.round(F.avg("delay"), 6).alias("mean_delay"), F.min("delay").alias("min_delay"), F.max("delay").alias("max_delay"), F.count_if(F.col("delay") < 0).alias("n_negative"))


def window_categories(windows: DataFrame, labels: DataFrame, match: tuple[int, int], guard: tuple[int, int], width: int = 4800) -> DataFrame:
    """Windows (start, target) whose target is in a label's half-open match region are event_associated; those that any part of touches a guard
    region are ignored; the rest are normal_reference. The last matching case counts; classes that differ make it ambiguous.

    Each window, whatever its length, meets the labels between the first and the last that can concern it, in buckets of ``width``.
    """
    first = F.least(F.col("target") - match[1] + 1, F.col("start") - guard[1] + 1)
    last = F.greatest(F.col("target") + match[0], F.col("target") + guard[0])
    spans = windows.select("start", "target", first.alias("_lo"), last.alias("_hi"))
    j = bucket_join(labels.select("case_id", "class", "t"), spans, "t", "_lo", "_hi", width, "right")
    m = (F.col("target") >= F.col("t") - match[0]) & (F.col("target") < F.col("t") + match[1])
    g = (F.col("target") >= F.col("t") - guard[0]) & (F.col("start") < F.col("t") + guard[1])
    own = F.when(m, F.col("class"))
    out = j.groupBy("start", "target").agg(F.max(F.when(m, F.col("case_id"))).alias("last_case"), F.coalesce(F.min(own) != F.max(own), F.lit(False)).alias("ambiguous"), F.coalesce(F.bool_or(m), F.lit(False)).alias("m"), F.coalesce(F.bool_or(g), F.lit(False)).alias("g"))
    kind = F.when(F.col("m"), "event_associated").when(F.col("g"), "ignore").otherwise("normal_reference")
    return out.select("start", "target", kind.alias("category"), "ambiguous", F.when(~F.col("ambiguous"), F.col("last_case")).alias("case_id"))


def labelled_grid(grid: DataFrame, labels: DataFrame, step: int = 600) -> DataFrame:
    """The grid with ``pos``: whether a label is in the step."""
    on = labels.select((F.floor(F.col("t") / step) * step).alias("t")).distinct().withColumn("p", F.lit(True))
    return grid.join(on, "t", "left").select("t", "score", F.coalesce("p", F.lit(False)).alias("pos"))


def counted(scored: DataFrame) -> DataFrame:
    """(score, p, n): the positives and negatives of each score; all that threshold metrics need."""
    return scored.groupBy("score").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))


def threshold_search(scored: DataFrame, steps: int, most: float) -> DataFrame:
    """The smallest of the percentile grid of negative scores with a false-positive rate of at most ``most``.

    The grid and its rates come from running counts by score: above a percentile are all negatives but those up to its lower neighbour.
    """
    grid = grid_quantiles(counted(scored), "score", "n", steps)
    return grid.where((F.col("n") - F.col("upto")) / F.col("n") <= most).agg(F.min("tau").alias("tau"))


def confusion_at(scored: DataFrame, taus: DataFrame) -> DataFrame:
    """tp, fp, fn and tn of the strict ``score > tau`` for each of a few thresholds, from counts by score."""
    hit = F.col("score") > F.col("tau")
    add = lambda c, h, n: F.sum(F.when(hit if h else ~hit, F.col(c)).otherwise(0)).alias(n)
    return counted(scored).join(F.broadcast(taus)).groupBy("tau").agg(add("p", True, "tp"), add("n", True, "fp"), add("p", False, "fn"), add("n", False, "tn"))


def node_errors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Masked mean squared error per key: (error, valid); a key without observed cells has error 0 and isn't valid. Cells: target, predicted, mask."""
    seen = F.count_if(F.col("mask"))
    total = F.sum(F.when(F.col("mask"), F.pow(F.col("predicted") - F.col("target"), 2)))
    return cells.groupBy(*keys).agg(F.coalesce(F.try_divide(total, seen), F.lit(0.0)).alias("error"), (seen > 0).alias("valid"))


def calibrate(errors: DataFrame, node: str = "node", floor: float = 1e-6, part: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per node (of each key): median, iqr and scale, the iqr held above max(floor, part of the median iqr); ``floored`` says where it is."""
    q = errors.where("valid").groupBy(*keys, node).agg(F.percentile("error", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*keys, node, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    eps = q.groupBy(*keys).agg(F.greatest(F.lit(floor), part * F.percentile("iqr", F.lit(0.5))).alias("eps"))
    q = q.join(eps, list(keys)) if keys else q.crossJoin(F.broadcast(eps))
    return q.select(*keys, node, "median", "iqr", F.greatest("iqr", "eps").alias("scale"), (F.col("iqr") < F.col("eps")).alias("floored"))


def window_scores(errors: DataFrame, stats: DataFrame, window: str = "window", node: str = "node", top: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per window (of each key): m1 the largest error, m2 the largest normalised error, m3 the mean of the ``top`` largest; -inf without valid nodes."""
    z = errors.join(stats, [*keys, node]).select(*keys, window, F.when(F.col("valid"), F.col("error")).alias("e"), F.when(F.col("valid"), (F.col("error") - F.col("median")) / F.col("scale")).alias("z"))
    best = F.slice(F.sort_array(F.collect_list("z"), asc=False), 1, top)
    out = z.groupBy(*keys, window).agg(F.max("e").alias("m1"), F.max("z").alias("m2"), best.alias("_best"))
    mean = F.when(F.size("_best") > 0, F.aggregate("_best", F.lit(0.0), lambda a, b: a + b) / F.size("_best"))
    low = F.lit(float("-inf"))
    return out.select(*keys, window, F.coalesce("m1", low).alias("m1"), F.coalesce("m2", low).alias("m2"), F.coalesce(mean, low).alias("m3"))
