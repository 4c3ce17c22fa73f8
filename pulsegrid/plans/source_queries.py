"""Queries that write tables with the sinks into the shared folder and read them back with the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.session import scratch
from pulsegrid.sources import cache, files

from .registry import query
from .views import table


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    """A table as CSV with an ordered header, read back strictly by its schema."""
    c, path = table(spark, sf, "customer"), scratch(spark, "csv")
    columns = ["c_mktsegment", "c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    files.write_csv(c, path, columns)
    return files.read_strict_csv(spark, path, "c_mktsegment STRING, c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE").select(sorted(columns))


@query("csv_rows", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey::VARCHAR END AS n_regionkey FROM nation")
def _(spark, sf):
    """Any CSV as rows of text, an empty cell as null."""
    n, path = table(spark, sf, "nation"), scratch(spark, "csv")
    files.write_csv(n.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey"))), path, n.columns)
    return files.read_csv_rows(spark, path)


@query("json_round_trip", "SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events")
def _(spark, sf):
    """JSON lines, appended to in two goes; numbers that aren't finite are null."""
    v = F.when(F.col("event_id") % 9 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    e, path = table(spark, sf, "events").select("event_id", "event_type", v.alias("value")), scratch(spark, "json")
    files.write_json(e.where("event_id % 2 = 0"), path)
    files.write_json(e.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE").json(path)


FACT = "SELECT date_trunc('month', o_orderdate)::DATE AS utc_date, o_orderkey, o_orderdate AS at, o_totalprice FROM orders"


def stored_fact(spark, sf, mode):
    o = table(spark, sf, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("utc_date"), "o_orderkey", F.col("o_orderdate").alias("at"), "o_totalprice")
    path = scratch(spark, "fact")
    files.write_fact(o, path, order=("at", "o_orderkey"))
    if mode:
        files.write_fact(o.where("o_orderkey % 2 = 0"), path, order=("at", "o_orderkey"), mode=mode)
    return spark.read.parquet(path)


@query("fact_days", f"WITH f AS ({FACT}), d AS (SELECT DISTINCT utc_date FROM f ORDER BY 1 LIMIT 3) SELECT utc_date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM f JOIN d USING (utc_date) GROUP BY utc_date")
def _(spark, sf):
    """A fact table in a folder per date, of which the first dates only are read."""
    days = files.first_days(stored_fact(spark, sf, None), 3)
    return days.groupBy("utc_date").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("fact_append", f"WITH f AS ({FACT}) SELECT utc_date, count(*) + count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n FROM f GROUP BY utc_date")
def _(spark, sf):
    return stored_fact(spark, sf, "append").groupBy("utc_date").agg(F.count("*").alias("n"))


@query("fact_dates_inside", f"WITH f AS ({FACT}) SELECT utc_date, count(*) AS n, 0::BIGINT AS differ FROM f GROUP BY utc_date")
def _(spark, sf):
    """The date is a folder and a column of the files too: each file read by itself has it."""
    o = table(spark, sf, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("utc_date"), "o_orderkey")
    path = scratch(spark, "fact")
    files.write_fact(o, path, order=("o_orderkey",), inside=True)
    inner = spark.read.schema("utc_date DATE, o_orderkey BIGINT").option("recursiveFileLookup", True).parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "utc_date_day=([0-9-]+)", 1)
    return inner.select("utc_date", folder.alias("d")).groupBy("utc_date").agg(F.count("*").alias("n"), F.count_if(F.col("d") != F.col("utc_date").cast("string")).alias("differ"))


@query("cache_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    """Two parts put together by key into a stored table; a repeated key would be an error."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return files.build_cache([o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0")], "o_orderkey", scratch(spark, "cache"))


@query("dimension_manifest", "SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n_rows, true AS sized, 64 AS digest_chars UNION ALL SELECT 'region', (SELECT count(*) FROM region), true, 64")
def _(spark, sf):
    """Dimensions as single files, with rows, bytes and digest of each."""
    out = None
    for name in ("nation", "region"):
        m = files.write_dimension(table(spark, sf, name), scratch(spark, "dimension"), name)
        out = m if out is None else out.union(m)
    return out.select("name", "n_rows", (F.col("bytes") > 0).alias("sized"), F.length("sha256").alias("digest_chars"))


@query("inventory_check", "SELECT 'ok' AS status, 1::BIGINT AS n UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unexpected', 1")
def _(spark, sf):
    """Stored files against a list of what they should be: one is as listed, one has another digest, one is gone, one isn't listed."""
    path = scratch(spark, "inventory")
    for k in range(3):
        table(spark, sf, "region").withColumn("k", F.lit(k)).coalesce(1).write.parquet(f"{path}/{k}")
    found = files.inventory(spark, path).where("path like '%.parquet'")
    at = F.regexp_extract("path", "/([0-9])/[^/]+$", 1)
    listed = found.where(at != "2").withColumn("sha256", F.when(at == "1", F.lit("other")).otherwise(F.col("sha256")))
    listed = listed.unionByName(found.limit(1).select(F.lit("gone").alias("path"), "bytes", "sha256"))
    return files.verify_inventory(found, listed).groupBy("status").agg(F.count("*").alias("n"))


@query("span_lists", "WITH s AS (SELECT n_nationkey * 3 AS lo, n_nationkey * 3 + n_nationkey % 4 AS hi FROM nation), i AS (SELECT unnest(range(lo, hi + 1)) AS i FROM s) SELECT DISTINCT i::INTEGER AS i FROM i")
def _(spark, sf):
    """Spans of indices out of a text file."""
    path, k = scratch(spark, "spans"), F.col("n_nationkey")
    text = F.concat(F.lit("feat_span: "), (k * 3).cast("string"), F.lit(" - "), (k * 3 + k % 4).cast("string"))
    table(spark, sf, "nation").select(text.alias("value")).write.text(path)
    return files.expand_spans(spark.read.text(path), "value")


@query("case_folders", "SELECT CASE s_nationkey % 2 WHEN 0 THEN 'cart' ELSE 'front-end' END AS service, CASE s_nationkey % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'mem' ELSE 'loss' END AS fault, (s_nationkey % 2 + 1)::VARCHAR AS run, count(*) * 2 AS n, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS n_missing, round(sum(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END), 2) AS total, sum(s_suppkey)::DOUBLE AS keys, 360::BIGINT AS inject_time FROM supplier GROUP BY ALL")
def _(spark, sf):
    """A tree of <service>_<fault>/<run> folders whose CSVs differ in their columns, read in one scan."""
    k, root = F.col("s_nationkey"), scratch(spark, "cases")
    s = table(spark, sf, "supplier").select(F.when(k % 2 == 0, "cart").otherwise("front-end").alias("service"), F.when(k % 3 == 0, "cpu").when(k % 3 == 1, "mem").otherwise("loss").alias("fault"), (k % 2 + 1).cast("string").alias("run"), "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.round("s_acctbal", 2)).alias("v"))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.coalesce(F.col("v").cast("decimal(18,2)").cast("string"), F.lit("")), F.col("s_suppkey").cast("string"))
    body = s.groupBy("service", "fault", "run").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    head = F.concat(F.lit("time,"), F.col("service"), F.lit("_load,"), F.col("fault"), F.lit("_id\n"))
    files.write_case_folders(body.select("service", "fault", "run", F.concat(head, F.col("b")).alias("csv"), F.lit("360\n").alias("inject")), root)
    long = files.read_case_folders(spark, root)
    load = F.col("metric").endswith("_load")
    seen = F.when(~F.isnan("value"), F.col("value"))
    out = long.groupBy("service", "fault", "run").agg(F.count("*").alias("n"), F.count_if(F.isnan("value")).alias("n_missing"), F.round(F.sum(F.when(load, F.coalesce(seen, F.lit(0.0)))), 2).alias("total"), F.sum(F.when(~load, F.col("value"))).alias("keys"), F.max("inject_time").alias("inject_time"))
    return out


@query("cache_by_change", "WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, o_totalprice FROM orders) SELECT 1 AS reading, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM a UNION ALL SELECT 2, count(*), round(sum(o_totalprice), 2) FROM a UNION ALL SELECT 3, count(*), round(sum(o_totalprice), 2) FROM b")
def _(spark, sf):
    """A kept table read three times; before the third reading rows are added to its files."""
    o, path, held = table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), scratch(spark, "kept"), cache.Cache(spark)
    o.where("o_orderkey % 2 = 0").write.parquet(path)
    count = lambda k: held.table(path).agg(F.lit(k).alias("reading"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).collect()
    rows = count(1) + count(2)
    o.where("o_orderkey % 2 <> 0").write.mode("append").parquet(path)
    rows += count(3)
    held.clear()
    return spark.createDataFrame(rows, "reading int, n long, total double")
