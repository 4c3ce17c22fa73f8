"""JSON trees as rows: every node by its path, searches for keys, differences with a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, keys: list[str], json: str, depth: int = 8) -> DataFrame:
    """(keys, path, key, value) of every node below the root; ``value`` is null for objects and arrays, and the JSON text of others.

    Nothing is shuffled; the table is read once for each level up to ``depth``. A deeper tree is an error, a null one has no nodes.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("$").alias("path"), F.parse_json(json).alias("v"))
    out = None
    for k in range(depth + 1):
        step = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_v"))
        place = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("_key")))
        level = step.select(*keys, F.concat("path", place).alias("path"), F.col("_key").alias("key"), F.col("_v").alias("v"))
        if k == depth:  # the message has the row's path, so the filter can't move ahead of the step
            level = level.where(F.raise_error(F.concat(F.lit("a tree that is too deep: "), F.col("path"))).cast("boolean"))
        kind = F.schema_of_variant("v")
        rows = level.select(*keys, "path", "key", F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.to_json("v")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def keys_like(df: DataFrame, keys: list[str], json: str, pattern: str) -> DataFrame:
    """(keys, path) of the nodes whose key matches a pattern."""
    return flatten(df, keys, json).where(F.col("key").rlike(pattern)).select(*keys, "path")


def tree_diff(a: DataFrame, b: DataFrame, keys: list[str], json: str, rtol: float = 1e-9) -> DataFrame:
    """(keys, path, side, left, right) of leaves on one side only, or that differ by more than a relative tolerance; texts compare exactly."""
    leaves = lambda d: flatten(d, keys, json).where("value is not null").select(*keys, "path", "value")
    on = [*keys, "path"]
    j = leaves(a).withColumnRenamed("value", "left").join(leaves(b).withColumnRenamed("value", "right"), on, "full_outer")
    x, y = F.expr("try_cast(left as double)"), F.expr("try_cast(right as double)")
    near = F.coalesce(F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
    side = F.when(F.col("right").isNull(), "left_only").when(F.col("left").isNull(), "right_only").otherwise("changed")
    return j.where(~(F.col("left").eqNullSafe(F.col("right")) | near)).select(*on, side.alias("side"), "left", "right")
