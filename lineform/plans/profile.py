"""Queries of the domain profile and of damaged documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineform.contract import Contract, Field
from lineform.operators import documents as D
from lineform.operators import domain as P
from lineform.plans.wire import t

_TEXT, _INT = {"type": "string"}, {"type": "integer"}


def _object(**fields) -> dict:
    return {"type": "object", "fields": [{"name": n, "optional": False, "schema": s} for n, s in fields.items()]}


ORDERS = P.Domain("o", {"type": "array", "items": _object(status=_TEXT, priority=_TEXT)})
LINES = P.Domain("l", _object(supplier=_INT, rows={"type": "array", "items": _object(flag=_TEXT, mode=_TEXT, part=_INT, quantity={"type": "number"})}), ("rows",))
NUMBERS = P.Domain("p", {"type": "array", "items": _object(a=_INT, b=_TEXT)})


def _order_cells(spark, d, documents):
    rows = t(spark, d, "orders").select(documents.alias("doc_id"), F.col("o_orderkey").alias("pos"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("r"))
    return rows.select("doc_id", "pos", F.array("r.status", "r.priority").alias("cells"))


def constant_columns(spark, d):
    constant, _ = P.savings(_order_cells(spark, d, F.concat((F.col("o_custkey") % 20).cast("string"), "o_orderstatus")), ORDERS, dictionaries=False)
    return constant.groupBy("idx", "cell").agg(F.count("*").alias("n"))


def dictionary_columns(spark, d):
    _, coded = P.savings(_order_cells(spark, d, F.col("o_custkey") % 50), ORDERS, shared=False)
    return coded.select("doc_id", "idx", F.array_join("values", ",").alias("book"))


def _line_documents(spark, d):
    row = F.struct(F.col("l_returnflag").alias("flag"), F.concat(F.lit("status of "), "l_linestatus").alias("mode"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("quantity"))
    by = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return by.select(F.col("supplier").alias("doc_id"), F.parse_json(F.to_json(F.struct("supplier", "rows"))).alias("v"))


def domain_roundtrip(spark, d):
    """Lines by supplier, written with constants and dictionaries and read back."""
    back = P.decode_records(P.encode(_line_documents(spark, d), LINES), LINES)
    r = F.from_json("json", "flag string, mode string, part long, quantity double")
    return back.select("doc_id", r.alias("r")).groupBy("doc_id", "r.flag", "r.mode").agg(F.count("*").alias("n"), F.sum("r.part").alias("parts"), F.sum(F.col("r.quantity").cast("long")).alias("quantity"))


def domain_header_sizes(spark, d):
    """Lines of the written documents: the header's entries and the number of records."""
    lines = P.encode_lines(_line_documents(spark, d), LINES)
    return lines.groupBy("doc_id").agg((F.count("*") - 1).alias("n"), F.max(F.when(F.col("pos") < 0, F.regexp_extract("line", r"\|n=(\d+)\|", 1).cast("long"))).alias("declared"))


def kinds_of_props(spark, d):
    found = P.paths(t(spark, d, "events").select(F.parse_json("props").alias("v")))
    return spark.createDataFrame([("/".join(p), k, n) for p, kinds in found if p for k, n in kinds.items()], "path string, kind string, n long")


def transport_repair(spark, d):
    body = F.concat(F.lit("p|v=1|n=1\n"), F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit("﻿"), body)).when(k == 1, F.concat(F.lit("```mini\n"), body, F.lit("\n```\n"))).when(k == 2, F.concat(F.lit("```\n"), body)).when(k == 3, F.concat(F.replace(body, F.lit("\n"), F.lit("\r\n")), F.lit("\n\n\n"))).otherwise(body)
    return t(spark, d, "orders").select("o_orderkey", F.md5(P.transport_repaired(text)).alias("digest"))


def _number_documents(spark, d):
    """Orders by customer; of every third one the number is broken."""
    row = F.concat_ws("|", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderkey").cast("string")), F.col("o_orderstatus"))
    by = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("l")))).alias("ls"))
    text = F.concat(F.lit("p|v=1|n="), F.size("ls").cast("string"), F.lit(f"|h={NUMBERS.schema_id}\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    return by.select("doc_id", text.alias("text"), "ls")


def domain_diagnose(spark, d):
    found = P.diagnose(_number_documents(spark, d).drop("ls"), NUMBERS)
    return found.select("doc_id", "ok", F.size("valid_lines").alias("valid"), F.size("invalid_lines").alias("invalid"), F.array_join(F.array_distinct(F.transform("errors", lambda e: e["code"])), ",").alias("codes"))


def apply_replacements(spark, d):
    """Broken lines are replaced by right ones; of every tenth customer a right line is named too, which is refused."""
    docs = _number_documents(spark, d)
    each = docs.select("doc_id", F.posexplode("ls").alias("i", "x"))
    new = each.where("x.o_orderkey % 3 = 0 OR doc_id % 10 = 0").select("doc_id", (F.col("i") + 2).alias("line"), F.concat_ws("|", F.col("x.o_orderkey").cast("string"), F.lit("R")).alias("new"))
    done = P.apply_replacements(docs.drop("ls"), new, NUMBERS)
    return done.select("doc_id", F.coalesce("code", F.lit("")).alias("code"))


# ---- faults of documents of a contract

PAIRS = Contract("a", (Field("k", "int"), Field("v")), (Field("w", optional=True),))
MARKED = Contract("m", (Field("k", "int"), Field("xs", "list", item="int", low=1, high=3), Field("ys", "mlist")), header=(Field("c", "int", optional=True),))
POINTS = Contract("t", (Field("k", "int", unique=True), Field("p", "tuple", parts=(Field("x", "int"), Field("y", "float", optional=True)))))


def _documents(spark, d, head, line):
    """Documents by customer of a line for each order; head gives the header from the number of lines."""
    by = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("ls"))
    return by.select("doc_id", F.concat(head(F.size("ls")), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


def _n(prefix: str):
    return lambda n: F.concat(F.lit(f"{prefix}|n="), n.cast("string"))




def _codes(spark, docs, contract):
    return D.records(docs, contract).select(F.explode_outer("errors").alias("e")).groupBy(F.coalesce("e.code", F.lit("")).alias("code"), F.coalesce("e.field", F.lit("")).alias("field")).agg(F.count("*").alias("n"))


def arity_errors(spark, d):
    tail = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "|v|w|z").when(F.col("o_orderkey") % 5 == 2, "|v|w").otherwise("|v")
    return _codes(spark, _documents(spark, d, _n("a"), F.concat(F.col("o_orderkey").cast("string"), tail)), PAIRS)


def count_mismatch(spark, d):
    head = lambda n: F.concat(F.lit("a|n="), (n + F.col("doc_id") % 3 - 1).cast("string"))
    found = D.diagnostics(_documents(spark, d, head, F.concat(F.col("o_orderkey").cast("string"), F.lit("|v"))), PAIRS)
    return found.select("doc_id", "missing", "excess", F.exists("errors", lambda e: e["code"] == "E04").alias("e04"))


def list_and_marker_errors(spark, d):
    """Too long lists, bad items in them, missing and double marks; the size counts before the items."""
    k = F.col("o_orderkey") % 6
    xs = F.when(k == 0, "1,2,x,4").when(k == 1, "1,x").when(k == 2, "").otherwise("1,2")
    ys = F.when(k == 3, "a,b").when(k == 4, "a*,b*").otherwise('a,"b,c"*')
    return _codes(spark, _documents(spark, d, _n("m"), F.concat_ws("|", F.col("o_orderkey").cast("string"), xs, ys)), MARKED)


def truncation_flag(spark, d):
    """Documents that break off in their last line, in one of three ways, or don't."""
    docs = _documents(spark, d, _n("a"), F.concat(F.col("o_orderkey").cast("string"), F.lit("|v")))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.regexp_replace("text", r"\|v\z", "")).when(k == 1, F.concat("text", F.lit("\\"))).when(k == 2, F.concat("text", F.lit("|w|z"))).otherwise(F.col("text"))
    return D.diagnostics(docs.select("doc_id", text.alias("text")), PAIRS).select("doc_id", "truncated", "valid")


def tuple_decode(spark, d):
    part = F.concat_ws(",", (F.col("o_orderkey") % 7).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(".5"))))
    rows = D.decode(_documents(spark, d, _n("t"), F.concat_ws("|", F.col("o_orderkey").cast("string"), part)), POINTS)
    return rows.groupBy("p.x").agg(F.count("*").alias("n"), F.count("p.y").alias("ys"), F.sum("p.y").alias("total"))


_BAD = "SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS bad FROM orders GROUP BY 1"

QUERIES = {
    "constant_columns": (constant_columns, "WITH o AS (SELECT *, (o_custkey % 20) || o_orderstatus AS doc_id FROM orders), c AS (SELECT doc_id, 0 AS idx, o_orderstatus AS cell FROM o UNION ALL SELECT doc_id, 1, o_orderpriority FROM o), g AS (SELECT doc_id, idx, min(cell) AS cell, max(cell) AS high, count(*) AS rows FROM c GROUP BY 1, 2) SELECT idx, cell, count(*) AS n FROM g WHERE rows >= 3 AND cell = high AND rows * (strlen(cell) + 1) > strlen('[' || idx || ',\"' || cell || '\"]') + 6 GROUP BY 1, 2"),
    "dictionary_columns": (dictionary_columns, "WITH o AS (SELECT *, o_custkey % 50 AS doc_id FROM orders), c AS (SELECT doc_id, o_orderkey AS pos, 0 AS idx, o_orderstatus AS cell FROM o UNION ALL SELECT doc_id, o_orderkey, 1, o_orderpriority FROM o), v AS (SELECT doc_id, idx, cell, count(*) AS k, min(pos) AS f FROM c GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY f) - 1 AS code FROM v), s AS (SELECT doc_id, idx, sum(k) AS n, count(*) AS m, sum(length(cell)) AS chars, sum(strlen(cell) * k) AS before, sum(strlen(code::VARCHAR) * k) AS digits, strlen('[' || idx || ',' || to_json(list(cell ORDER BY code))::VARCHAR || ']') + 4 AS cost, string_agg(cell, ',' ORDER BY code) AS book FROM w GROUP BY 1, 2) SELECT doc_id, idx, book FROM s WHERE n >= 6 AND m BETWEEN 2 AND 64 AND 3 * m <= n AND chars >= 6 * m AND before - digits - cost > greatest(32, cost // 3)"),
    "domain_roundtrip": (domain_roundtrip, "SELECT l_suppkey AS doc_id, l_returnflag AS flag, 'status of ' || l_linestatus AS mode, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2, 3"),
    "domain_header_sizes": (domain_header_sizes, "SELECT l_suppkey AS doc_id, count(*) AS n, count(*) AS declared FROM lineitem GROUP BY 1"),
    "kinds_of_props": (kinds_of_props, "WITH k AS (SELECT props, unnest(json_keys(props)) AS path FROM events) SELECT path, CASE json_type(props, '$.' || path) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(json_type(props, '$.' || path)) END AS kind, count(*) AS n FROM k GROUP BY 1, 2"),
    "transport_repair": (transport_repair, "SELECT o_orderkey, md5('p|v=1|n=1' || chr(10) || o_orderkey || CASE WHEN o_orderkey % 5 = 3 THEN chr(10) ELSE '' END) AS digest FROM orders"),
    "domain_diagnose": (domain_diagnose, f"WITH b AS ({_BAD}) SELECT doc_id, bad = 0 AS ok, n - bad AS valid, bad AS invalid, CASE WHEN bad = 0 THEN '' ELSE 'D_VALUE' END AS codes FROM b"),
    "apply_replacements": (apply_replacements, f"WITH b AS ({_BAD}) SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND bad = n OR doc_id % 10 <> 0 AND bad > 0 THEN '' ELSE 'D_REPAIR' END AS code FROM b"),
    "arity_errors": (arity_errors, "SELECT CASE WHEN o_orderkey % 5 < 2 THEN 'E05' ELSE '' END AS code, '' AS field, count(*) AS n FROM orders GROUP BY 1"),
    "count_mismatch": (count_mismatch, "SELECT o_custkey AS doc_id, greatest(o_custkey % 3 - 1, 0) AS missing, greatest(1 - o_custkey % 3, 0) AS excess, o_custkey % 3 <> 1 AS e04 FROM orders GROUP BY o_custkey"),
    "list_and_marker_errors": (list_and_marker_errors, "WITH o AS (SELECT o_orderkey % 6 AS k FROM orders) SELECT CASE k WHEN 0 THEN 'E07' WHEN 1 THEN 'E06' WHEN 2 THEN 'E07' WHEN 3 THEN 'E08' WHEN 4 THEN 'E08' ELSE '' END AS code, CASE WHEN k <= 2 THEN 'xs' WHEN k <= 4 THEN 'ys' ELSE '' END AS field, count(*) AS n FROM o GROUP BY 1, 2"),
    "truncation_flag": (truncation_flag, "SELECT o_custkey AS doc_id, o_custkey % 4 < 2 AS truncated, count(*) - (o_custkey % 4 < 3)::INT AS valid FROM orders GROUP BY o_custkey"),
    "tuple_decode": (tuple_decode, "SELECT o_orderkey % 7 AS x, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS ys, sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 + 0.5 END)::DOUBLE AS total FROM orders GROUP BY 1"),
}
