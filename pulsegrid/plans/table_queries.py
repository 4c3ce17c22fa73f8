"""Queries on the star schema, on table quality and on sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import maths
from pulsegrid.operators import warehouse as wh

from .registry import query
from .views import ALERTS, CASES, TEL, alerts, cases, table, tel

STAR = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def star(spark, sf):
    """Dimensions are joined by key; Spark broadcasts those that are small and shuffles the rest."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("star_split_counts", f"SELECT r_name, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(sum(l_quantity), 2) AS quantity {STAR} GROUP BY 1, 2")
def _(spark, sf):
    s = star(spark, sf)
    d = F.col("o_orderdate")
    split = F.when(d < F.lit("1997-01-01").cast("timestamp_ntz"), "train").when(d < F.lit("1999-01-01").cast("timestamp_ntz"), "validation").otherwise("test")
    return s.groupBy("r_name", split.alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


NODES = "nodes AS (SELECT n_name AS service, n_name || '-' || k AS node FROM nation, unnest(range(0, 3)) u(k)), asked AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN n_name || '-1' WHEN s_suppkey % 3 = 1 THEN n_name ELSE 'none' END AS cmdb FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("exact_or_prefix_match", f"WITH {NODES} SELECT a.s_suppkey, a.cmdb, n.node, 'exact' AS how FROM asked a JOIN nodes n ON n.node = a.cmdb UNION ALL SELECT a.s_suppkey, a.cmdb, n.node, CASE WHEN n.node IS NULL THEN 'unresolved' ELSE 'replicas' END FROM asked a LEFT JOIN nodes n ON n.service = a.cmdb WHERE a.cmdb NOT IN (SELECT node FROM nodes)")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    nodes = nation.select(F.col("n_name").alias("service"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("service", F.concat_ws("-", "service", F.col("k").cast("string")).alias("node"))
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.concat("n_name", F.lit("-1"))).when(k == 1, F.col("n_name")).otherwise("none")
    asked = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", name.alias("cmdb"))
    return wh.exact_or_prefix(asked, nodes, "cmdb", "node", "service")


@query("node_dimension", f"WITH {NODES}, a AS (SELECT node AS name FROM nodes UNION ALL SELECT n_name FROM nation) SELECT name, CASE WHEN regexp_matches(name, '-[0-9]+$') THEN 'container' ELSE 'vm' END AS kind, CASE WHEN regexp_matches(name, '-[0-9]+$') THEN regexp_extract(name, '^(.*)-([0-9]+)$', 1) END AS service, CASE WHEN regexp_matches(name, '-[0-9]+$') THEN regexp_extract(name, '-([0-9]+)$', 1)::INTEGER END AS replica FROM a")
def _(spark, sf):
    nation = table(spark, sf, "nation").select("n_name")
    names = nation.select("n_name", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("k")).select(F.concat_ws("-", "n_name", "k").alias("name")).union(nation)
    return names.select("name", *wh.name_parts(F.col("name")))


@query("crosstab", "SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    n = j.groupBy("c_mktsegment").agg(F.count("*").alias("total"))
    return p.join(n, "c_mktsegment").select("c_mktsegment", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), "total")


@query("pivot", f"SELECT r_name, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS a, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS n, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS r {STAR} GROUP BY r_name")
def _(spark, sf):
    p = star(spark, sf).groupBy("r_name").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("r_name", *(F.round(F.col(c), 2).alias(c.lower()) for c in "ANR"))


@query("grouping_sets", f"SELECT r_name, l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS discount {STAR} GROUP BY GROUPING SETS ((), (r_name), (l_returnflag), (r_name, l_returnflag))")
def _(spark, sf):
    return star(spark, sf).select("r_name", "l_returnflag", "l_discount").cube("r_name", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("pooled_metrics", "WITH " + TEL + " SELECT channel, count(*) AS n, round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END), 6) AS above FROM tel GROUP BY GROUPING SETS ((), (channel))")
def _(spark, sf):
    return tel(spark, sf).rollup("channel").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 90).cast("double")), 6).alias("above"))


@query("fault_share", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6).alias("share"))


@query("top_k", "SELECT * FROM (SELECT n_name, s_suppkey, round(s_acctbal, 2) AS balance, row_number() OVER (PARTITION BY n_name ORDER BY abs(s_acctbal) DESC, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE place <= 3")
def _(spark, sf):
    from pyspark.sql import Window as W

    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = W.partitionBy("n_name").orderBy(F.desc(F.abs("s_acctbal")), "s_suppkey")
    return j.select("n_name", "s_suppkey", F.round("s_acctbal", 2).alias("balance"), F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("most_common", "SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_type ORDER BY n DESC, first_seen LIMIT 5")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(5)


@query("first_per_group", "SELECT n_name AS service, min(s_suppkey) AS first_key, arg_min(s_name, s_suppkey) AS first_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("service")).agg(F.min("s_suppkey").alias("first_key"), F.min_by("s_name", "s_suppkey").alias("first_name"))


@query("warehouse_verify", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity IS NULL) AS nulls, round(sum(l_extendedprice::DECIMAL(28, 12)), 3)::DOUBLE AS value_sum FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_quantity").isNull()).alias("nulls"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(28,12)")), 3).cast("double").alias("value_sum"))


@query("partition_counts", "SELECT (epoch_us(l_shipdate)//1000000//86400//30)::BIGINT AS month, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY 1")
def _(spark, sf):
    from pulsegrid.functions.timeutil import epoch

    return table(spark, sf, "lineitem").groupBy(F.floor(epoch("l_shipdate") / 86400 / 30).alias("month")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("window_fetch", "WITH " + TEL + " SELECT event_id, t, channel, value FROM tel WHERE t BETWEEN 1704500000 AND 1704510000")
def _(spark, sf):
    tel(spark, sf).createOrReplaceTempView("pulsegrid_tel")
    return spark.sql("SELECT event_id, t, channel, value FROM pulsegrid_tel WHERE t BETWEEN :lo AND :hi", args={"lo": 1704500000, "hi": 1704510000})


@query("column_presence", "WITH p AS (SELECT source, 'lang' AS c, count(lang) AS k FROM documents GROUP BY source UNION ALL SELECT source, 'text', count(nullif(text, '')) FROM documents GROUP BY source) SELECT c AS column_name, count(*) AS n_sources, count(*) FILTER (WHERE k > 0) AS present, min(k) AS least FROM p GROUP BY c")
def _(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("lang").alias("lang"), F.count(F.nullif("text", F.lit(""))).alias("text"))
    long = d.unpivot("source", ["lang", "text"], "column_name", "k")
    return long.groupBy("column_name").agg(F.count("*").alias("n_sources"), F.count_if(F.col("k") > 0).alias("present"), F.min("k").alias("least"))


@query("missing_cells", "WITH " + TEL + ", m AS (SELECT user_id, event_id, channel, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v, t < 1705276800 AS pre FROM tel) SELECT channel, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) FILTER (WHERE v IS NULL AND pre) AS n_pre, count(*) FILTER (WHERE v IS NULL AND NOT pre) AS n_post, min(event_id) FILTER (WHERE v IS NULL) AS first_id, max(event_id) FILTER (WHERE v IS NULL) AS last_id FROM m GROUP BY channel")
def _(spark, sf):
    m = tel(spark, sf).withColumn("v", F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value")))
    gone, pre = F.col("v").isNull(), F.col("t") < 1705276800
    return m.groupBy("channel").agg(F.count_if(gone).alias("n_missing"), F.count_if(gone & pre).alias("n_pre"), F.count_if(gone & ~pre).alias("n_post"), F.min(F.when(gone, F.col("event_id"))).alias("first_id"), F.max(F.when(gone, F.col("event_id"))).alias("last_id"))


@query("duplicates", "SELECT (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicate_texts, (SELECT count(*) - count(DISTINCT epoch_us(ts)//1000000) FROM events) AS duplicate_seconds")
def _(spark, sf):
    d = table(spark, sf, "documents").agg((F.count("*") - F.count_distinct("text")).alias("duplicate_texts"))
    return d.crossJoin(tel(spark, sf).agg((F.count("*") - F.count_distinct("t")).alias("duplicate_seconds")))


@query("imputation", "WITH " + TEL + ", n AS (SELECT event_id, channel, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM tel), s AS (SELECT channel, avg(v) AS m, greatest(stddev_samp(v), 1e-8) AS sd FROM n WHERE NOT isnan(v) GROUP BY channel) SELECT event_id, round(CASE WHEN isnan(v) THEN 0.0 ELSE (v - m) / sd END, 5) AS z, isnan(v) AS imputed FROM n JOIN s USING (channel)")
def _(spark, sf):
    from pulsegrid.operators import profile

    n = tel(spark, sf).select("event_id", "channel", F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("v"))
    s = profile.fit_scaler(n, ["channel"], "v", sample=True)
    return n.join(s, "channel").select("event_id", F.round((F.nanvl("v", "mean") - F.col("mean")) / F.col("scale"), 5).alias("z"), F.isnan("v").alias("imputed"))


@query("split_overlap", "WITH s AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'validation' ELSE 'test' END AS split, o_custkey AS id FROM orders) SELECT a.split AS s1, b.split AS s2, count(*) AS n FROM s a JOIN s b ON a.id = b.id AND a.split < b.split GROUP BY 1, 2")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    s = table(spark, sf, "orders").select(F.when(k == 0, "train").when(k == 1, "validation").otherwise("test").alias("split"), F.col("o_custkey").alias("id")).distinct()
    a, b = s.select(F.col("split").alias("s1"), "id"), s.select(F.col("split").alias("s2"), "id")
    return a.join(b, "id").where("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("n"))


@query("set_ops", "WITH " + ALERTS + ", a AS (SELECT DISTINCT t FROM cs), b AS (SELECT DISTINCT t FROM al) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS both_sides, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b")
def _(spark, sf):
    a, b = cases(spark, sf).select("t").distinct(), alerts(spark, sf).distinct()
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(a.union(b).distinct(), "both_sides").crossJoin(n(a.intersect(b), "shared")).crossJoin(n(a.subtract(b), "only_a")).crossJoin(n(b.subtract(a), "only_b"))


PARTS = "a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 501 = 0), u AS (FROM a UNION ALL FROM b), o AS (SELECT o_orderkey, o_totalprice FROM orders)"


@query("union_test", f"WITH {PARTS} SELECT (SELECT count(*) FROM (FROM o EXCEPT ALL FROM u)) AS missing, (SELECT count(*) FROM (FROM u EXCEPT ALL FROM o)) AS added, (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM u) AS n_parts")
def _(spark, sf):
    """Whether a table is the union of two parts, by key and value, each row as often as it is there; the parts here lack some rows, change some and repeat some."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    odd = o.where(k % 2 == 1).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 97 == 1, 1).otherwise(0))
    return wh.union_check(o, o.where(k % 2 == 0).unionByName(odd).unionByName(o.where(k % 501 == 0)))


@query("digest", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md, length(text) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"), F.length("text").cast("long").alias("n"))


@query("quality_checks", "WITH " + TEL + ", c AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 70 = 0 THEN 'odd' ELSE channel END AS ch, t FROM tel), r AS (SELECT 'null_value' AS \"check\", count(*) FILTER (WHERE v IS NULL) AS violations FROM c UNION ALL SELECT 'unknown_channel', count(*) FILTER (WHERE ch NOT IN ('click', 'error', 'purchase', 'signup', 'view')) FROM c UNION ALL SELECT 'negative_value', count(*) FILTER (WHERE v < 0) FROM c UNION ALL SELECT 'time_range', count(*) FILTER (WHERE t < 1704067200) FROM c) SELECT \"check\", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM r")
def _(spark, sf):
    c = tel(spark, sf).select(F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(F.col("value")).alias("v"), F.when(F.col("event_id") % 70 == 0, "odd").otherwise(F.col("channel")).alias("ch"), "t")
    return wh.check_table(c, {"null_value": F.col("v").isNull(), "unknown_channel": ~F.col("ch").isin("click", "error", "purchase", "signup", "view"), "negative_value": F.col("v") < 0, "time_range": F.col("t") < 1704067200})


@query("table_diff", "WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 97 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice * (1 + 1e-12) END AS o_totalprice FROM orders WHERE o_orderkey % 101 <> 0), j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey AS x, b.o_orderkey AS y, a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_totalprice AS p1, b.o_totalprice AS p2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey), u AS (SELECT k, 'o_orderstatus' AS c, x, y, s1 = s2 AS ok FROM j UNION ALL SELECT k, 'o_totalprice', x, y, abs(p1 - p2) <= 1e-9 * greatest(abs(p1), abs(p2)) FROM j), d AS (SELECT c, CASE WHEN y IS NULL THEN 'left_only' WHEN x IS NULL THEN 'right_only' ELSE 'changed' END AS side, ok FROM u) SELECT c AS column_name, side, count(*) AS n FROM d WHERE side <> 'changed' OR NOT ok GROUP BY 1, 2")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    b = o.where(k % 101 != 0).select("o_orderkey", F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 83 == 0, F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice") * (1 + 1e-12)).alias("o_totalprice"))
    return wh.table_diff(o.where(k % 97 != 0), b, ["o_orderkey"]).groupBy(F.col("column").alias("column_name"), "side").agg(F.count("*").alias("n"))


@query("level_rollup", "WITH " + CASES + " SELECT CASE WHEN class = 0 THEN 'user-' || user_id ELSE 'class-' || class END AS grp, count(*) AS n FROM cs GROUP BY 1")
def _(spark, sf):
    g = F.when(F.col("class") == 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("class-"), F.col("class").cast("string")))
    return cases(spark, sf).groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


@query("class_reindex", "WITH " + CASES + ", k AS (SELECT unnest(range(0, 7)) AS class) SELECT k.class, count(cs.case_id) AS n FROM k LEFT JOIN cs ON cs.class = k.class GROUP BY k.class")
def _(spark, sf):
    n = cases(spark, sf).groupBy("class").agg(F.count("*").alias("c"))
    return spark.range(7).withColumnRenamed("id", "class").join(n, "class", "left").select("class", F.coalesce("c", F.lit(0)).alias("n"))


@query("unmapped_types", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'error') GROUP BY event_type")
def _(spark, sf):
    known = spark.createDataFrame([("click",), ("view",), ("error",)], "event_type string")
    return table(spark, sf, "events").join(known, "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("conversation_spans", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT turn) AS n, max(turn) - min(turn) = count(DISTINCT turn) - 1 AS contiguous FROM conversations GROUP BY conv_id")
def _(spark, sf):
    n = F.count_distinct("turn")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), n.alias("n"), ((F.max("turn") - F.min("turn")) == n - 1).alias("contiguous"))


@query("role_changes", "SELECT conv_id, turn, role, p AS previous FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NULL OR p <> role")
def _(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").withColumn("previous", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.where("previous is null or previous <> role").select("conv_id", "turn", "role", "previous")


@query("label_budget", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT unnest([10, 25, 50, 100]) AS pct) SELECT p.pct, c.label, greatest(1, n * pct // 100) AS budget FROM c, p")
def _(spark, sf):
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    pct = spark.createDataFrame([(x,) for x in (10, 25, 50, 100)], "pct int")
    return c.crossJoin(pct).select("pct", "label", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("pct") / 100)).alias("budget"))


@query("graph_placement", "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 25 AS vm FROM lineitem), p AS (SELECT s, count(*) AS n_vms, min(vm) AS vm FROM e GROUP BY s) SELECT s, n_vms, vm, n_vms <= 1 AS single FROM p")
def _(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 25).alias("vm")).distinct()
    return e.groupBy("s").agg(F.count("*").alias("n_vms"), F.min("vm").alias("vm"), (F.count("*") <= 1).alias("single"))


@query("topology_counts", "WITH g AS (SELECT l_orderkey, md5(string_agg(l_linenumber::VARCHAR || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag)) AS h FROM lineitem GROUP BY l_orderkey) SELECT h, count(*) AS n FROM g GROUP BY h")
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return g.groupBy(F.md5(text).alias("h")).agg(F.count("*").alias("n"))


@query("ranked_selection", "SELECT p_brand, round(avg(p_retailprice), 4) AS price, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 5 ORDER BY avg(p_retailprice) DESC, count(*), p_brand LIMIT 1")
def _(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n")).where("n >= 5")
    return g.orderBy(F.desc("m"), "n", "p_brand").limit(1).select("p_brand", F.round("m", 4).alias("price"), "n")


@query("substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'steel') AND p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')")
def _(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_type").contains("steel") & F.col("p_size").between(10, 30) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).select("p_partkey", "p_name")


@query("rounding", "SELECT event_id, round_even(value, 2) AS even, round(CASE WHEN value > 0 THEN 1 / value ELSE 0.0 END, 6) AS safe, isnan(CASE WHEN value > 50 THEN value ELSE 'NaN'::DOUBLE END) AS undefined FROM events")
def _(spark, sf):
    v = F.col("value")
    safe, odd = F.round(maths.div0(F.lit(1.0), v), 6), F.isnan(maths.div_nan(v, F.when(v > 50, 1).otherwise(0)))
    return table(spark, sf, "events").select("event_id", maths.half_even(v, 2).alias("even"), safe.alias("safe"), odd.alias("undefined"))


@query("span_expansion", "WITH s AS (SELECT n_nationkey AS k, n_nationkey * 3 AS lo, n_nationkey * 3 + n_nationkey % 4 AS hi FROM nation) SELECT k, unnest(range(lo, hi + 1))::INTEGER AS i FROM s")
def _(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("k"), F.explode(F.sequence(k * 3, k * 3 + k % 4)).alias("i"))


@query("json_counts", "WITH c AS (SELECT event_type, user_id % 5 AS k, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM c GROUP BY event_type")
def _(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).cast("string").alias("k")).agg(F.count("*").alias("n"))
    m = c.groupBy("event_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    return m.select("event_type", F.to_json("m").alias("counts"))


