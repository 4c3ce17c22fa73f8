"""Checks of tables and splits as rows: leakage, roles, counts against what was approved, provenance, deliberate corruptions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import bucket_join


def rows_of(df: DataFrame, **values: Column) -> DataFrame:
    """(check, violations) of aggregates that are computed in one pass."""
    row = df.agg(*(c.cast("long").alias(n) for n, c in values.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).alias("violations")) for n in values))).alias("c")).select("c.*")


def window_roles(windows: DataFrame, boundary: int, embargo: int) -> DataFrame:
    """Adds role: fit where a window ends before the boundary less the embargo, validation where it starts at or after it, else embargo."""
    return windows.withColumn("role", F.when(F.col("target") < boundary - embargo, "fit").when(F.col("start") >= boundary, "validation").otherwise("embargo"))


def case_roles(roles: DataFrame, cases: DataFrame, width: int) -> DataFrame:
    """(case_id, in_fit, in_validation, role) of each case by the windows that hold its time; both sides at once is a leak, no window is none."""
    hit = bucket_join(cases, roles, "t", "start", "target", width, "left")
    out = hit.groupBy("case_id").agg(*(F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(f"in_{r}") for r in ("fit", "validation")))
    side = F.when(F.col("in_fit") & F.col("in_validation"), "both").when(F.col("in_fit"), "fit").when(F.col("in_validation"), "validation").otherwise("none")
    return out.withColumn("role", side)


def leakage(roles: DataFrame, cases: DataFrame, boundary: int, embargo: int, step: int, width: int) -> DataFrame:
    """(check, violations, status) of a split of windows: crossing the boundary, in the embargo, shared moments, cases on both sides, repeats."""
    fit, val = F.col("role") == "fit", F.col("role") == "validation"
    sides = rows_of(
        roles, fit_reaches_embargo=F.count_if(fit & (F.col("target") >= boundary - embargo)), validation_starts_early=F.count_if(val & (F.col("start") < boundary)),
        crosses_boundary=F.count_if((F.col("role") != "embargo") & (F.col("start") < boundary) & (F.col("target") >= boundary)), empty_side=2 - F.max(fit.cast("int")) - F.max(val.cast("int")),
    )
    moments = roles.select("role", F.explode(F.sequence("start", "target", F.lit(step).cast("long"))).alias("m")).groupBy("m")
    shared = rows_of(moments.agg(F.bool_or(fit).alias("f"), F.bool_or(val).alias("v")), shared_moments=F.count_if(F.col("f") & F.col("v")))
    cases_both = rows_of(case_roles(roles, cases, width), case_on_both_sides=F.count_if(F.col("role") == "both"))
    repeats = rows_of(roles.groupBy("start").agg(F.count("*").alias("n")), repeated_window=F.count_if(F.col("n") > 1))
    out = reduce(DataFrame.union, (sides, shared, cases_both, repeats))
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def split_leakage(windows: DataFrame, cases: DataFrame, boundary: int, embargo: int, test: int, step: int) -> DataFrame:
    """(check, violations, status) of ten leakage checks of labelled windows (start, target, role, category, case_id, fault, reason) and cases (case_id, t, grp).

    Roles are fit, calibration, embargo, test and others; fault is -1 where a window has none; a group is an incident that several cases share.
    """
    role, target, start = F.col("role"), F.col("target"), F.col("start")
    event = F.col("category") == "event_associated"
    plain = rows_of(
        windows, l5_window_leaves_its_region=F.count_if(((role == "fit") & (target >= boundary - embargo)) | ((role == "calibration") & ((start < boundary) | (target >= test)))),
        l6_role_outside_its_period=F.count_if((role.isin("fit", "calibration") & (target >= test)) | ((role == "test") & (start < test))), l8_stray_embargo=F.count_if((role == "embargo") & ~((target >= boundary - embargo) & (start < boundary))),
        l9_unexplained_event_window=F.count_if(event & (F.col("fault") == -1) & F.col("reason").isNull()), l10_inconsistent_reason=F.count_if(F.col("reason").isNotNull() & ~((F.col("fault") == -1) & event)),
    )
    sides = lambda d, *keys: d.groupBy(*keys).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("f", role == "fit"), ("c", role == "calibration"))))
    moments = sides(windows.where(role.isin("fit", "calibration")).select("role", F.explode(F.sequence("start", "target", F.lit(step).cast("long"))).alias("m")), "m")
    shared = rows_of(moments, l1_shared_moment=F.count_if(F.col("f") & F.col("c")))
    own = windows.where(event & F.col("case_id").isNotNull() & role.isin("fit", "calibration")).select("case_id", "role").distinct()
    by_case = sides(cases.join(own, "case_id", "left"), "case_id", "t", "grp")
    case_rows = rows_of(by_case, l2_case_on_both_sides=F.count_if(F.col("f") & F.col("c")), l4_train_case_not_on_one_side=F.count_if((F.col("t") < test) & (F.col("f") == F.col("c"))))
    groups = rows_of(by_case.groupBy("grp").agg(F.bool_or("f").alias("f"), F.bool_or("c").alias("c")), l3_group_on_both_sides=F.count_if(F.col("f") & F.col("c")))
    place, t = F.struct("t", "case_id"), F.col("t")
    cut = rows_of(cases, l7_cut_inside_a_group=F.when(F.max_by("grp", F.when(t < boundary, place)) != F.min_by("grp", F.when((t >= boundary) & (t < test), place)), 0).otherwise(1))
    out = reduce(DataFrame.union, (shared, case_rows, groups, plain, cut))
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def against(found: DataFrame, approved: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, found, approved, status): ok, differs, missing or unexpected counts."""
    j = found.select(*keys, F.col(n).alias("found")).join(approved.select(*keys, F.col(n).alias("approved")), keys, "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("approved").isNull(), "unexpected").when(F.col("found") == F.col("approved"), "ok").otherwise("differs")
    return j.withColumn("status", status)


def corrupted(df: DataFrame, corruptions: dict[str, dict[str, Column]], checks: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """(corruption, check, violations): each named change of columns, applied to the whole table, and what each check counts in it.

    A check is a function of the columns by name. All changes and checks are counts of one pass over the table, which gives one row;
    no changed table is ever made.
    """
    own = {c: F.col(c) for c in df.columns}
    cells = {(name, check): f(own | changes) for name, changes in corruptions.items() for check, f in checks.items()}
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, c in enumerate(cells.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("corruption"), F.lit(c).alias("check"), F.col(f"_{k}").alias("violations")) for k, (n, c) in enumerate(cells)))).alias("c")).select("c.*")


def schema_issues(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What differs from the expected column types, in words; it never raises, and an empty list is a pass."""
    have = dict(df.dtypes)
    gone = [f"missing {c}" for c in expected if c not in have]
    odd = [f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    return gone + odd + [f"unexpected {c}" for c in have if c not in expected]


def mask_of(keys: list[Column], rate: float, seed: str) -> Column:
    """A repeatable random predicate: true for about ``rate`` of the keys, the same at every run and on every engine with MD5."""
    return F.substring(F.md5(F.concat_ws("-", F.lit(seed), *(k.cast("string") for k in keys))), 1, 6) < f"{round(rate * 16**6):06x}"


def seeded_split(df: DataFrame, group: str, item: str, seed: str, sizes: tuple[tuple[str, int], ...]) -> DataFrame:
    """Adds place and split: the items of each group in the order of a seeded hash, the first ``n`` for each named size in turn; null beyond."""
    order = W.partitionBy(group).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(group).cast("string"), F.col(item).cast("string"))), item)
    place, split, end = F.col("place"), F.lit(None).cast("string"), sum(n for _, n in sizes)
    for name, n in reversed(sizes):
        split, end = F.when(place <= end, name).otherwise(split), end - n
    return df.withColumn("place", F.row_number().over(order).cast("long")).withColumn("split", split)
