import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from lineform.functions.tokens import token_count
from lineform.operators import economics, formats, matching, pointers, selection
from lineform.operators import statistics as A


def test_greedy_match_against_a_loop(spark):
    r = random.Random(5)
    side = lambda: [(d, i, *(r.choice("ab") if r.random() > 0.1 else None for _ in range(3))) for d in range(12) for i in range(r.randrange(0, 9))]
    got, expected = side(), side()
    want = set()
    for d in range(12):
        pairs = [(sum(a == b for a, b in zip(g[2:], e[2:])), -abs(g[1] - e[1]), g[1], e[1]) for g in got for e in expected if g[0] == e[0] == d]
        used_g, used_e = set(), set()
        for s, _, g, e in sorted((p for p in pairs if p[0] >= 2), reverse=True):
            if g not in used_g and e not in used_e:
                used_g.add(g)
                used_e.add(e)
                want.add((d, g, e, s))
    schema = "doc_id long, pos int, a string, b string, c string"
    g, e = spark.createDataFrame(got, schema), spark.createDataFrame(expected, schema)
    out = matching.greedy_match(matching.field_scores(g, e, "doc_id", ["a", "b", "c"]), "doc_id")
    assert {tuple(x) for x in out.collect()} == want
    warned = spark.createDataFrame([(d, d % 2 == 0) for d in range(13)], "doc_id long, warned boolean")
    m = {x.doc_id: x for x in matching.extraction_metrics(g, e, "doc_id", ["a", "b", "c"], warned).collect()}
    for d in range(13):
        own = [x for x in want if x[0] == d]
        n_e = sum(x[0] == d for x in expected)
        assert (m[d].correct, m[d].lost, m[d].lost_silently) == (sum(x[3] == 3 for x in own), n_e - len(own), 0 if d % 2 == 0 else n_e - len(own))


def test_matching_of_many_copies(spark):
    """Two documents of copies: their pairs are never made, and what is taken is what the ordered pairs give."""
    fields, schema = ["a", "b", "c"], "doc_id long, pos long, a long, b string, c double"
    r = random.Random(7)
    side = lambda n, m: [(d, p, r.randrange(m), r.choice("xy"), r.choice([0.0, -0.0, None, 1.0])) for d in (1, 2) for p in r.sample(range(4 * n), n)]
    small = [spark.createDataFrame(side(60, 2), schema) for _ in range(2)]
    pairs = matching.field_scores(*small, "doc_id", fields)
    want = {tuple(x) for x in matching.greedy_match(pairs, "doc_id").collect()}
    assert {tuple(x) for x in matching.matched(*small, "doc_id", fields).collect()} == want
    classes = {(x.doc_id, x.score): (x.n, x.gs, x.es) for x in matching.class_scores(*small, "doc_id", fields).groupBy("doc_id", "score").agg(F.sum(F.expr("g_n * e_n")).alias("n"), F.sum(F.expr("g_sum * e_n")).alias("gs"), F.sum(F.expr("e_sum * g_n")).alias("es")).collect()}
    assert classes == {(x.doc_id, x.score): (x.n, x.gs, x.es) for x in pairs.groupBy("doc_id", "score").agg(F.count("*").alias("n"), F.sum("g").alias("gs"), F.sum("e").alias("es")).collect()}
    large = [spark.range(60_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 2 + i).alias("pos"), F.lit(1).alias("a"), F.lit("x").alias("b"), F.lit(None).cast("double").alias("c")) for i in range(2)]
    assert matching.class_scores(*large, "doc_id", fields).select("g_n", "e_n", "score").collect() == [(60_000, 60_000, 3)]
    assert matching.matched(*large, "doc_id", fields).count() == 60_000


def test_quantiles_and_scores(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), ("c", 5.0)], "g string, x double")
    got = {r.g: (r.value, r.determined) for r in A.censored_quantile(rows, ["g"], "x", 0.5).collect()}
    assert got == {"a": (3.0, True), "b": (None, False), "c": (5.0, True)}
    assert A.censored_quantile(rows, ["g"], "x", 0.75).where("g = 'a'").first().value is None
    df = spark.createDataFrame([([5, 1] * 5,), ([1] * 9,), ([6] + [1] * 9,), (None,), ([3] * 10,)], "a array<int>")
    assert [r[0] for r in df.select(A.usability_score(F.col("a"))).collect()] == [100.0, None, None, None, 50.0]
    line = spark.createDataFrame([("up", 1, 1.0), ("up", 2, 2.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("one", 1, 7.0)], "g string, x int, y double")
    assert {r.g: r.x_cross for r in A.interpolated_crossing(line, ["g"], "x", "y", 4.0).collect()} == {"up": 4.0, "flat": float("inf"), "one": 1.0}


def test_pointers_round_trip(spark):
    texts = ['{"a":[1,[],{}],"b/c":{"~d":null,"e":"x\\"y"}}', "[]", '"s"', '{"0":1,"1":2}', '[[["z"]]]']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    leaves = pointers.flatten(df)
    assert {r.pointer for r in leaves.where("doc_id = 0").collect()} == {"/a/0", "/a/1", "/a/2", "/b~1c/~0d", "/b~1c/e"}
    back = {r.doc_id: r.json for r in pointers.unflatten(leaves).collect()}
    assert back == {0: '{"a":[1,[],{}],"b/c":{"e":"x\\"y","~d":null}}', 1: "[]", 2: '"s"', 3: "[1,2]", 4: texts[4]}
    codes = {r.v: r.code for r in pointers.code_scheme(spark.createDataFrame([("ab",), ("abc",), ("b",), (None,)], "v string"), "v").collect()}
    assert codes == {"ab": "ab", "abc": "abc", "b": "b"}


def test_pointers_read_their_source_once(spark):
    """Neither a level nor a rebuilt value reads its documents again; what is nested too deep is an error, not left out."""
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":[1,{"e":2}]}}}}')], "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    scans = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + x._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    leaves = pointers.flatten(df)
    assert scans(leaves) == 1 and scans(pointers.unflatten(leaves)) == 1
    assert {(x.pointer, x.json) for x in leaves.collect()} == {("/a/b/c/d/0", "1"), ("/a/b/c/d/1/e", "2")}
    deep = spark.createDataFrame([(1, "[" * 70 + '"]["' + "]" * 70)], "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    with pytest.raises(ValueError, match="70 levels"):
        pointers.flatten(deep)
    assert pointers.flatten(deep, most_depth=80).first().json == '"]["'


def test_events_and_fences(spark):
    df = spark.createDataFrame([(1, "data: a\ndata:b\n\n: ping\n\nevent: end\ndata\n\n"), (2, "")], "k long, text string")
    assert [(r.k, r.event, r.data) for r in formats.server_events(df, "k").collect()] == [(1, "message", "a\nb"), (1, "end", "")]
    one = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string")
    assert [r[0] for r in one.select(formats.fence_stripped(F.col("t"))).collect()] == ["{}", "{}"]
    strict = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("NaN",), ("[1",)], "t string")
    assert [r[0] is not None for r in strict.select(formats.strict_json(F.col("t"))).collect()] == [True, False, False, False]


def test_selection_and_costs(spark):
    assert selection.design_matrix(spark, a=["x", "y"], b=[1, 2]).count() == 4
    assert spark.range(1).select(selection.cut_points(F.lit(11), 2)).first()[0] == [3, 7]
    row = spark.range(1).select(economics.cost_per_thousand(F.lit(7), F.lit(0)).alias("a"), economics.budget_capacity(F.lit(10), F.lit(3), F.lit(2)).alias("b"), economics.projected_saving(F.lit(100), F.lit("0.5"), F.lit(4)).alias("c")).first()
    assert (row.a.state, row.a.incurred, row.b.batches, row.b.records, row.c.share) == ("undefined", 7, 3, 6, 0.5)


def test_token_count(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 257}
    path = os.path.join(tmp_path, "ranks")
    with open(path, "wb") as f:
        f.write(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items()))
    del tiktoken
    df = spark.createDataFrame([("ab ab",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"), path)).collect()] == [2, 0, None, 2]
