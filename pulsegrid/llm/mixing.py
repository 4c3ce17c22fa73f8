"""Mixing sources to target weights on a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over the run, t from 0 to 1. Its integral is the source's cumulative demand of tokens; the
inverse of that demand gives each document, at its offset in its source's stream, a training position; documents are sorted by
position. A source's stream is its documents in the order of a hash of their ids, repeated where the target is above the size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, OWN, keyed, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes; and the most that a source gives, in times its size.
SHARE, MOST = 1.5, 2.0
#: A weight's course over the run, as knots (time from 0 to 1, factor of the weight) with straight lines between them.
Schedule = Sequence[tuple[float, float]]
#: Schedules of the sources in code point order, repeating: one that starts strong, and its mirror.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of a hash that split a source's stream into runs at least, and documents of a run on average.
DIGITS, RUN_ROWS = 3, 1_000_000


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, place) of each source of ``sizes`` (source, size).

    Weights are dealt in code point order, a null source last. A target is its weight's part of ``share`` of all sizes, but at
    most ``most`` times the source's size; what is cut off is shared by weight among the others until none is above. With the
    sources in the order of size over weight, those at their limit come first, so running sums give the level at once: that of the
    first source below its limit, which is the highest of those below. An empty source has target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    per = per.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    by = one.orderBy(F.col("source_size") / F.col("weight"), "place")
    ahead = by.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(one) * share).withColumn("cut", F.coalesce(F.sum(F.col("source_size") * most).over(ahead), F.lit(0.0)))
    per = per.withColumn("left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    per = per.withColumn("level", (F.col("budget") - F.col("cut")) / F.col("left")).withColumn("full", F.col("source_size") * most <= F.col("level") * F.col("weight"))
    per = per.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(one))
    target = F.when(F.col("full") | F.col("final").isNull(), F.col("source_size") * most).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"), "place")


def checked(schedule: Schedule) -> Schedule:
    """``schedule`` if it is one: times from 0 to 1, rising, and weights of at least 0 whose integral is above 0."""
    times, heights = [float(t) for t, _ in schedule], [float(w) for _, w in schedule]
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times[:-1], times[1:], strict=True)) or min(heights) < 0 or max(heights) <= 0:
        raise ValueError(f"not a schedule: {schedule}")
    return tuple(zip(times, heights, strict=True))


def inverse_demand(part: Column, schedule: Schedule) -> Column:
    """The time at which the integral of a schedule reaches ``part`` of its whole.

    Between two knots the weight is linear, so the demand is a quadratic, and its inverse is written without a difference of
    nearly equal numbers. A stretch of weight 0 is passed over: nothing trains in it.
    """
    knots = checked(schedule)
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True)]
    goal = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * sum(areas)
    out, before, every = None, 0.0, [k for k, a in enumerate(areas) if a > 0]
    for k in every:
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        rest = F.greatest(goal - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * rest * ((w1 - w0) / (t1 - t0)), F.lit(0.0)))
        time = F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0))
        before += areas[k]
        here = F.least(time, F.lit(t1))
        out = (here if k == every[-1] else F.when(goal <= before, here)) if out is None else out.otherwise(here) if k == every[-1] else out.when(goal <= before, here)
    return out


def position_of(part: Column, place: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """The training position of ``part`` of a source's target; the schedules are dealt to the sources by their place, repeating."""
    out = None
    for k, schedule in enumerate(schedules):
        mine = place % len(schedules) == k
        out = F.when(mine, inverse_demand(part, schedule)) if out is None else out.when(mine, inverse_demand(part, schedule))
    return out


def offsets(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (source, hash, size, the row key) with ``start``: the words of its source before each document, in the order of hash, tie and row key.

    The tie is a hash of the row key. Three sums are put together: of the runs before, runs being prefixes of the hash; of the
    hashes and prefixes of the tie before within the run, a row each; and of the rows before with the very same hash and prefix. So
    ids that are null or repeat, however often, are spread over 16^``DIGITS`` windows; a run has about ``RUN_ROWS`` rows.
    """
    digits = max(DIGITS, math.ceil(math.log(max(rows, 1) / RUN_ROWS, 16)))
    s, tie = OWN + "s", F.md5(F.col(KEY).cast("string"))
    df = df.withColumn(s, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).withColumn("run", F.substring("hash", 1, digits)).withColumn("tie", F.substring(tie, 1, DIGITS))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    keys = [s, "run", "hash", "tie"]
    parts = df.groupBy(*keys).agg(F.sum("size").alias("words"))
    runs = parts.groupBy(s, "run").agg(F.sum("words").alias("words"))
    runs = runs.select(s, "run", sums("words", W.partitionBy(s).orderBy("run")).alias("first"))
    parts = parts.select(*keys, sums("words", W.partitionBy(s, "run").orderBy("hash", "tie")).alias("second"))
    df = df.withColumn("third", sums("size", W.partitionBy(*keys).orderBy(KEY)))
    found = df.join(parts, keys).join(runs, [s, "run"])
    return found.withColumn("start", F.col("first") + F.col("second") + F.col("third")).drop("run", "tie", "first", "second", "third")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, the row key, size, source_size, target, taken, copies, position and again.

    ``position`` and ``again`` are the training positions, 0 to 1, of its first and second use; null where there is none. Weights and
    schedules are dealt to the sources in code point order, a null source last, repeating.

    ``taken`` is the number of its words that the mix takes, repeats counted. The document in which a source reaches its target is
    cut there; with ``whole`` it is taken whole if at least half of it would be, so ``taken`` is copies times size. Null texts and
    texts without words have size 0 and take nothing; a text of any length is one document. Rows that repeat an id, or have none, are
    documents of their own, in an order of their row keys. An empty table gives no rows. Other columns are ignored.
    """
    df = docs if KEY in docs.columns else keyed(docs)
    df = df.select(F.col(f"`{id_col}`").alias("doc_id"), KEY, F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    df = written(df.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    aims = targets(df, weights).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias(OWN + "s"), "source_size", "target", "place")
    df = offsets(df, df.count()).join(aims, OWN + "s")
    start = F.col("start")
    goal = F.round("target").cast("long")
    got = [F.least(F.greatest(goal - start - F.col("source_size") * p, F.lit(0)), F.col("size")) for p in range(int(MOST))]
    uses = [((F.lit(2) * g >= F.col("size")) if whole else (g > 0)) & (F.col("size") > 0) for g in got]
    copies = sum((F.when(u, 1).otherwise(0) for u in uses[1:]), F.when(uses[0], 1).otherwise(0))
    taken = copies * F.col("size") if whole else sum(got[1:], got[0])
    spots = [F.when(u, F.round(position_of((start + F.col("source_size") * p + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)), F.col("place"), schedules), 6)) for p, u in enumerate(uses)]
    return df.select("doc_id", KEY, "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), spots[0].alias("position"), spots[1].alias("again"))


def mixed_order(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents that ``plan`` (of ``mix`` with ``whole``) takes, each as often as taken, range-sorted by training position.

    ``docs`` carries the row key that ``mix`` was given; its columns stay, nulls and all. Uses at the same position are in the order of
    the row key. Nothing taken gives no rows.
    """
    at = plan.where("copies > 0").select(KEY, F.explode(F.array_compact(F.array("position", "again"))).alias(OWN + "at"))
    return docs.join(at, KEY).repartitionByRange(OWN + "at", KEY).sortWithinPartitions(OWN + "at", KEY).drop(KEY, OWN + "at")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), r AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w
), l AS (
  SELECT *, (budget - cut) / rest AS level, source_size * 2.0::DOUBLE <= (budget - cut) / rest * weight AS filled FROM r
), t AS (
  SELECT source, source_size, place % 2 AS phase, CASE WHEN filled OR max(CASE WHEN NOT filled THEN level END) OVER () IS NULL THEN source_size * 2.0::DOUBLE
    ELSE max(CASE WHEN NOT filled THEN level END) OVER () * weight END AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.phase, round(t.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, least(greatest(goal - start, 0), size) AS g1, least(greatest(goal - start - source_size, 0), size) AS g2,
    least(greatest((start + size / 2.0::DOUBLE) / greatest(target, 1.0), 0.0), 1.0)::DOUBLE AS part,
    least(greatest((start + source_size + size / 2.0::DOUBLE) / greatest(target, 1.0), 0.0), 1.0)::DOUBLE AS part2, CASE WHEN phase = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS sl FROM c
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (g1 + g2)::BIGINT AS taken, (CASE WHEN g1 > 0 THEN 1 ELSE 0 END + CASE WHEN g2 > 0 THEN 1 ELSE 0 END)::INTEGER AS copies,
  CASE WHEN g1 > 0 THEN round(((1 + sl) - sqrt((1 + sl) * (1 + sl) - 4 * sl * part)) / (2 * sl), 6) END AS position,
  CASE WHEN g2 > 0 THEN round(((1 + sl) - sqrt((1 + sl) * (1 + sl) - 4 * sl * part2)) / (2 * sl), 6) END AS again FROM g
"""
