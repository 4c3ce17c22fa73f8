"""Star schema work: names, dimension checks, dense and long forms, verification, table differences and check tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_parts(name: Column) -> list[Column]:
    """kind, service and replica of a node name: the last dash parts them; a name without one is a machine."""
    cut = F.regexp_extract(name, r"^(.*)-(\d+)$", 1)
    return [F.when(cut == "", "vm").otherwise("container").alias("kind"), F.when(cut != "", cut).alias("service"), F.when(cut != "", F.regexp_extract(name, r"-(\d+)$", 1).cast("int")).alias("replica")]


def exact_or_prefix(asked: DataFrame, nodes: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """(asked columns, node, how): the node of that very name, else each node of that group, else unresolved. Two equi-joins, no OR."""
    exact = asked.join(nodes.select(F.col(name).alias("_n")), F.col(key) == F.col("_n"), "left")
    hit = exact.where("_n is not null").select(*asked.columns, F.col("_n").alias("node"), F.lit("exact").alias("how"))
    rest = exact.where("_n is null").drop("_n").join(nodes.select(F.col(name).alias("node"), F.col(group).alias("_g")), F.col(key) == F.col("_g"), "left")
    return hit.unionByName(rest.select(*asked.columns, "node", F.when(F.col("node").isNull(), "unresolved").otherwise("replicas").alias("how")))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing at run time on the first row that breaks the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def to_dense(df: DataFrame, keys: list[str], index: str, v: str, size: int) -> DataFrame:
    """One array per key, in index order; a key without all ``size`` entries is an error."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, v))).alias("s"))
    return require(rows, F.size("s") == size, "a key with missing or repeated entries").select(*keys, F.col(f"s.{v}").alias("values"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9) -> DataFrame:
    """(keys, column, side, left, right) of what differs: rows on one side only, and values beyond a relative tolerance. Nulls are equal."""
    cols = [c for c in a.columns if c not in keys]
    j = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    there = lambda s: F.coalesce(*(F.col(f"{s}.{k}").isNotNull() for k in keys))
    numeric = {c for c, t in a.dtypes if t in ("double", "float") or t.startswith("decimal")}

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        near = F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y)) if c in numeric else x == y
        return x.eqNullSafe(y) | F.coalesce(near, F.lit(False))

    side = F.when(~there("b"), "left_only").when(~there("a"), "right_only").otherwise("changed")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("left"), F.col(f"b.{c}").cast("string").alias("right"), same(c).alias("same")) for c in cols))
    out = j.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), side.alias("side"), F.explode(cells).alias("x")).where("side <> 'changed' or not x.same")
    return out.select(*keys, "x.column", "side", "x.left", "x.right")


def union_check(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: rows of ``whole`` that ``parts`` lacks (missing), rows that it has beyond (added), and both numbers of rows (n, n_parts). Both sides are counted in one shuffle."""
    cols = whole.columns
    tagged = whole.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(parts.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = tagged.groupBy(*cols).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return per.agg(more("a", "b").alias("missing"), more("b", "a").alias("added"), F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_parts"))


def check_table(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations, status) of named conditions, in one pass over the table; a condition marks rows that break the rule."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks))).alias("c")).select("c.*")
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))
