"""Queries of the analytics layer over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineform.operators import selection
from lineform.operators import statistics as A
from lineform.plans.wire import t


def group_ratio_of_sums(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("long")).alias("q"), F.col("l_linenumber").cast("long").alias("l"))
    return rows.groupBy("l_returnflag").agg(F.round(A.ratio_of_sums(F.col("q"), F.col("l")), 9).alias("ratio"), F.round(F.avg(F.col("q") / F.col("l")), 6).alias("mean_ratio"))


def poisoned_group_sum(spark, d):
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("g"), "o_orderkey")
    return rows.groupBy("g").agg(A.poisoned_sum(F.col("o_orderkey"), F.col("o_orderkey") % 499 != 0).alias("total"))


def quantiles(spark, d):
    return t(spark, d, "lineitem").groupBy("l_shipdate").agg(A.nearest_rank("l_quantity", 0.95).alias("p95"), F.median("l_quantity").alias("median"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def wilson_interval(spark, d):
    by = t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count("*").alias("n"))
    low, high = A.wilson(F.col("s"), F.col("n"))
    return by.select("l_linestatus", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def linear_fit_r2(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


def category_rollup(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", A.micro_units(F.col("l_tax")).alias("m"))
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.sum("m").alias("micro"), F.grouping_id().alias("level"))


def outcome_histogram_pivot(spark, d):
    kinds = ["error", "click", "signup", "view", "purchase"]
    return t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", kinds).count().na.fill(0)


def pairing_self_join(spark, d):
    """Lines 1 and 2 of an order; the last of a repeated line counts."""
    rows = A.latest(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])
    one, two = rows.where("l_linenumber = 1").selectExpr("l_orderkey", "l_quantity AS a"), rows.where("l_linenumber = 2").selectExpr("l_orderkey", "l_quantity AS b")
    return one.join(two, "l_orderkey").select("l_orderkey", (F.col("a") - F.col("b")).alias("difference"))


def rate_lookup_left_join(spark, d):
    rates = t(spark, d, "region").select(F.lower(F.trim("r_name")).alias("name"), (F.col("r_regionkey") + 1).alias("rate")).where("rate < 4")
    left = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lower(F.trim("r_name")).alias("name"))
    return left.join(rates, "name", "left").select("n_name", F.when(F.col("rate").isNotNull(), F.col("rate") * 1000).alias("cost"), F.when(F.col("rate").isNull(), "no rate").otherwise("").alias("reason"))


def semi_and_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").where("o_orderstatus = 'F'")
    on = c["c_custkey"] == o["o_custkey"]
    has = c.join(o, on, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("having"))
    hasnt = c.join(o, on, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without"))
    return has.join(hasnt, "c_mktsegment", "full").select("c_mktsegment", F.coalesce("having", F.lit(0)).alias("having"), F.coalesce("without", F.lit(0)).alias("without"))


def range_join_cut_points(spark, d):
    """Lines of each document that end by each of ten equally spaced cuts."""
    docs = t(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text", F.posexplode(selection.cut_points(F.length("text"), 10)).alias("i", "cut"))
    head = F.substring(F.col("text"), F.lit(1), F.col("cut").cast("int"))
    return docs.select("doc_id", (F.col("i") + 1).alias("i"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("lines"))


def multiset_intersect(spark, d):
    part = t(spark, d, "part")
    return A.multiset_counts(part.where("p_size % 2 = 0").select("p_brand"), part.where("p_size % 3 = 0").select("p_brand"), "p_brand")


def ordinal_zip_join(spark, d):
    """Turns of a conversation beside the next ones."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return c.join(b, ["conv_id", "turn"]).groupBy("role", "next_role").agg(F.count("*").alias("n"))


def daily(spark, d):
    by = t(spark, d, "events").groupBy("event_type", F.dayofyear("ts").alias("x")).agg(F.count("*").alias("n"))
    return by.withColumn("y", F.sum("n").over(Window.partitionBy("event_type").orderBy("x")).cast("double"))


def interp_crossing(spark, d):
    return A.interpolated_crossing(daily(spark, d), ["event_type"], "x", "y", 3000.0).select("event_type", F.round("x_cross", 6).alias("x_cross"))


def persistent_crossing(spark, d):
    return A.persistent_crossing(daily(spark, d).withColumn("diff", F.col("y") - 100), ["event_type"], "x", "diff")


def marginal_slope(spark, d):
    return A.marginal_slope(daily(spark, d), ["event_type"], "x", "y").select("event_type", F.round("slope", 6).alias("slope"))


def first_appearance_codes(spark, d):
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 20).alias("doc_id"), "o_orderpriority", "o_orderkey")
    return A.first_appearance_codes(rows, "doc_id", "o_orderpriority", "o_orderkey")


def breaking_point(spark, d):
    """Least line count of an order with a returned line, and the largest up to which all sizes have some without."""
    by = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"), F.bool_or(F.col("l_returnflag") == "R").alias("bad"))
    return by.agg(F.min(F.when(F.col("bad"), F.col("size"))).alias("least_bad"), F.max(F.when(~F.col("bad"), F.col("size"))).alias("largest_good"))


def argmin_recall(spark, d):
    by = t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return by.groupBy("l_suppkey").agg(F.min("q").alias("least"), F.min_by("l_linenumber", F.struct("q", "l_linenumber")).alias("at"))


def set_operations(spark, d):
    o = t(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return one(a.intersectAll(b), "intersect_all").unionByName(one(a.exceptAll(b), "except_all")).unionByName(one(a.intersect(b), "intersect")).unionByName(one(a.subtract(b), "except"))


def sizes_by_format(spark, d):
    """Bytes of orders as compact JSON and as a wire line, and the saving."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    names = o.columns
    json = F.to_json(F.struct(*names))
    wire = F.concat_ws("|", *(F.col(c).cast("string") for c in names))
    by = o.groupBy("o_orderpriority").agg(F.sum(F.octet_length(json)).alias("json_bytes"), F.sum(F.octet_length(wire)).alias("wire_bytes"))
    return by.withColumn("saving", F.round(1 - F.col("wire_bytes") / F.col("json_bytes"), 6))


_DAILY = "WITH g AS (SELECT event_type, dayofyear(ts) AS x, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT event_type, x, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY x) AS DOUBLE) AS y FROM g)"

QUERIES = {
    "group_ratio_of_sums": (group_ratio_of_sums, "SELECT l_returnflag, round(sum(CAST(l_quantity AS BIGINT)) / sum(l_linenumber), 9) AS ratio, round(avg(CAST(l_quantity AS BIGINT) / l_linenumber), 6) AS mean_ratio FROM lineitem GROUP BY 1"),
    "poisoned_group_sum": (poisoned_group_sum, "SELECT o_custkey % 40 AS g, CASE WHEN bool_and(o_orderkey % 499 <> 0) THEN CAST(sum(o_orderkey) AS BIGINT) END AS total FROM orders GROUP BY 1"),
    "quantiles": (quantiles, "SELECT l_shipdate, quantile_disc(l_quantity, 0.95) AS p95, median(l_quantity) AS median, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1"),
    "wilson_interval": (wilson_interval, "WITH c AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS s, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT *, s / n AS p, 1 + 3.8416 / n AS b FROM c) SELECT l_linestatus, round(CASE WHEN s = 0 THEN 0.0 ELSE (p + 3.8416 / (2 * n)) / b - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / b END, 9) AS low, round(CASE WHEN s = n THEN 1.0 ELSE (p + 3.8416 / (2 * n)) / b + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / b END, 9) AS high FROM e"),
    "linear_fit_r2": (linear_fit_r2, "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1"),
    "category_rollup": (category_rollup, "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(CAST(l_tax AS DECIMAL(30,10)) * 1000000) AS BIGINT)) AS BIGINT) AS micro, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "outcome_histogram_pivot": (outcome_histogram_pivot, "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("error", "click", "signup", "view", "purchase")) + " FROM events GROUP BY 1"),
    "pairing_self_join": (pairing_self_join, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC) AS r FROM lineitem) SELECT a.l_orderkey, a.l_quantity - b.l_quantity AS difference FROM r a JOIN r b USING (l_orderkey) WHERE a.r = 1 AND b.r = 1 AND a.l_linenumber = 1 AND b.l_linenumber = 2"),
    "rate_lookup_left_join": (rate_lookup_left_join, "SELECT n_name, CASE WHEN r_regionkey < 3 THEN (r_regionkey + 1) * 1000 END AS cost, CASE WHEN r_regionkey < 3 THEN '' ELSE 'no rate' END AS reason FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "semi_and_anti": (semi_and_anti, "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS having, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS without FROM customer GROUP BY 1"),
    "range_join_cut_points": (range_join_cut_points, "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS s FROM d), e AS (SELECT doc_id, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM l), i AS (SELECT doc_id, n, unnest(range(1, 11)) AS i FROM d) SELECT i.doc_id, i.i, count(e.e) AS lines FROM i LEFT JOIN e ON e.doc_id = i.doc_id AND e.e <= i.n * i.i // 11 GROUP BY 1, 2"),
    "multiset_intersect": (multiset_intersect, "WITH a AS (SELECT p_brand, count(*) AS na FROM part WHERE p_size % 2 = 0 GROUP BY 1), b AS (SELECT p_brand, count(*) AS nb FROM part WHERE p_size % 3 = 0 GROUP BY 1), j AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (p_brand)) SELECT CAST(sum(least(na, nb)) AS BIGINT) AS identical, CAST(sum(CASE WHEN nb > 0 THEN greatest(na - nb, 0) ELSE 0 END) AS BIGINT) AS excess, CAST(sum(CASE WHEN nb = 0 THEN na ELSE 0 END) AS BIGINT) AS \"foreign\", CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS missing FROM j"),
    "ordinal_zip_join": (ordinal_zip_join, "SELECT a.role, b.role AS next_role, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 GROUP BY 1, 2"),
    "interp_crossing": (interp_crossing, _DAILY + ", w AS (SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py FROM d WINDOW p AS (PARTITION BY event_type ORDER BY x)), z AS (SELECT event_type, arg_min(CASE WHEN py IS NULL OR py >= 3000 THEN x ELSE px + (3000 - py) * (x - px) / (y - py) END, x) FILTER (y >= 3000) AS inside, arg_max(CASE WHEN y > py THEN x + (3000 - y) * (x - px) / (y - py) ELSE 'inf'::DOUBLE END, x) AS beyond FROM w GROUP BY 1) SELECT event_type, round(CAST(coalesce(inside, beyond) AS DOUBLE), 6) AS x_cross FROM z"),
    "persistent_crossing": (persistent_crossing, _DAILY + ", b AS (SELECT *, max(CASE WHEN y <= 100 THEN x END) OVER (PARTITION BY event_type) AS bad FROM d) SELECT event_type, min(CASE WHEN bad IS NULL OR x > bad THEN x END) AS x_from FROM b GROUP BY 1"),
    "marginal_slope": (marginal_slope, _DAILY + ", r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x DESC) AS r FROM d) SELECT event_type, round((max(y) FILTER (r = 1) - max(y) FILTER (r = 2)) / (max(x) FILTER (r = 1) - max(x) FILTER (r = 2)), 6) AS slope FROM r WHERE r <= 2 GROUP BY 1"),
    "first_appearance_codes": (first_appearance_codes, "WITH f AS (SELECT o_custkey % 20 AS doc_id, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT doc_id, o_orderpriority, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS code FROM f"),
    "breaking_point": (breaking_point, "WITH b AS (SELECT count(*) AS size, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_orderkey) SELECT min(size) FILTER (bad) AS least_bad, max(size) FILTER (NOT bad) AS largest_good FROM b"),
    "argmin_recall": (argmin_recall, "WITH b AS (SELECT l_suppkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q, l_linenumber) AS r FROM b) SELECT l_suppkey, q AS least, l_linenumber AS at FROM r WHERE r = 1"),
    "set_operations": (set_operations, "WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT 'intersect_all' AS kind, count(*) AS n FROM (FROM a INTERSECT ALL FROM b) UNION ALL SELECT 'except_all', count(*) FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)"),
    "sizes_by_format": (sizes_by_format, "WITH s AS (SELECT o_orderpriority, sum(strlen('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}')) AS j, sum(strlen(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority)) AS w FROM orders GROUP BY 1) SELECT o_orderpriority, CAST(j AS BIGINT) AS json_bytes, CAST(w AS BIGINT) AS wire_bytes, round(1 - w / j, 6) AS saving FROM s"),
}
