"""Queries of costs and resampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineform.operators import economics, resampling
from lineform.plans.wire import t


def usage_costs(spark, d):
    unpriced, included = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    tokens = {"input": F.col("l_orderkey"), "cache_read": F.when(F.col("l_linenumber") != 1, F.col("l_partkey")), "output": F.col("l_quantity").cast("long")}
    prices = {"input": F.lit("3"), "cache_read": F.when(~unpriced, F.lit("0.25")), "output": F.lit("15")}
    cost = economics.usage_cost(tokens, prices, F.col("l_linenumber"), included)
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", cost.alias("c")).select("l_returnflag", "l_linestatus", "c.state", "c.total")
    return rows.groupBy("l_returnflag", "l_linestatus", "state").agg(F.count("*").alias("n"), F.sum("total").cast("double").alias("micro"))


def break_even_sizes(spark, d):
    at = economics.break_even(F.col("l_linenumber") % 3, F.col("l_orderkey") % 5, F.col("l_partkey") % 7, F.col("l_partkey") % 4)
    rows = t(spark, d, "lineitem").select(at.alias("x")).select("x.*")
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.sum("k_min").alias("sum_min"), F.sum("k_max").alias("sum_max"))


def bootstrap_ratio(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 97).alias("cluster"), F.col("l_extendedprice").cast("double").alias("a"), F.col("l_quantity").cast("double").alias("b"))
    return resampling.cluster_ratio(rows, ["l_returnflag"], "cluster", "a", "b", 200)


QUERIES = {
    "usage_costs": (usage_costs, "WITH u AS (SELECT l_returnflag, l_linestatus, l_orderkey AS i, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS c, CAST(l_quantity AS BIGINT) AS o, l_linenumber AS r, l_returnflag = 'R' AS unpriced FROM lineitem), s AS (SELECT *, CASE WHEN unpriced AND c <> 0 THEN 'price_missing' WHEN NOT unpriced AND c IS NULL THEN 'usage_missing' WHEN l_linestatus = 'F' AND r > o THEN 'invalid' ELSE 'ok' END AS state FROM u) SELECT l_returnflag, l_linestatus, state, count(*) AS n, CAST(sum(CASE WHEN state = 'ok' THEN i * 3 + CASE WHEN unpriced THEN 0 ELSE c * 0.25 END + o * 15 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE r * 15 END END) AS DOUBLE) AS micro FROM s GROUP BY 1, 2, 3"),
    "break_even_sizes": (break_even_sizes, "WITH l AS (SELECT l_linenumber % 3 - l_partkey % 7 AS b, l_orderkey % 5 - l_partkey % 4 AS a FROM lineitem), s AS (SELECT a, b, CASE WHEN a > 0 THEN CASE WHEN a + b > 0 THEN 'always' ELSE 'from' END WHEN a = 0 THEN CASE WHEN b > 0 THEN 'always' ELSE 'never' END WHEN a + b > 0 THEN 'until' ELSE 'never' END AS state FROM l) SELECT state, count(*) AS n, CAST(sum(CASE state WHEN 'from' THEN (-b) // a + 1 WHEN 'never' THEN NULL ELSE 1 END) AS BIGINT) AS sum_min, CAST(sum(CASE WHEN state = 'until' THEN (b - 1) // (-a) END) AS BIGINT) AS sum_max FROM s GROUP BY 1"),
    "bootstrap_ratio": (bootstrap_ratio, None),
}
