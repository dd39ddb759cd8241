from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lineform.contract import Contract, Field
from lineform.operators import economics, repair, resampling

C = Contract("sc", (Field("id", unique=True), Field("qty", "int"), Field("color", "enum", values=("red", "green"))), (Field("memo", optional=True),))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("hello\n```\nsc|n=1\na|1|red\n```\nbye", "sc|n=1\na|1|red"),
        ("hello\nsc|n=1\r\na|1|red\nbye\n\n", "sc|n=1\na|1|red\nbye"),
        ("sc|n=1\n```\na|1|red", "sc|n=1\na|1|red"),
        ("```\nno header\n~~~\n", "no header"),
        ("~~~\n﻿ sc\nx", "﻿ sc\nx"),
    ],
)
def test_extracted(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(repair.extracted(F.col("text"), "sc")).first()[0] == want


DOC = "sc|n=6\na|1|red\nb|x|red\nc|2|blue\nd|3\nx|red\ne|9|red\nf|q|red\n"


def test_items(spark):
    rows = repair.invalid_items(spark.createDataFrame([(1, DOC), (2, "zz|n=0"), (3, None)], "doc_id long, text string"), C).orderBy("doc_id", "item").collect()
    assert [(r.doc_id, r.is_header, r.lines, r.text) for r in rows] == [(1, False, [3], "b|x|red"), (1, False, [4], "c|2|blue"), (1, False, [5, 6], "d|3\nx|red"), (1, False, [8], "f|q|red"), (2, True, [1], "zz|n=0")]


@pytest.mark.parametrize(
    ("line", "want"),
    [((5, 2, 1, 1), ("always", 1, None)), ((0, 2, 3, 1), ("from", 4, None)), ((10, 1, 0, 3), ("until", 1, 4)), ((1, 1, 1, 1), ("never", None, None)), ((2, 1, 1, 1), ("always", 1, None)), ((0, 1, 0, 2), ("never", None, None)), ((None, 1, 0, 2), (None, None, None))],
)
def test_break_even(spark, line, want):
    df = spark.createDataFrame([line], "a long, b long, c long, d long")
    assert tuple(df.select(economics.break_even(*map(F.col, "abcd")).alias("x")).first().x) == want


def test_batch_cost(spark):
    df = spark.range(1).select(economics.batch_cost(*(F.lit(x) for x in (10, 100, 5, 7, 3)), F.lit(0.5), F.lit(0.2), F.lit(1), F.lit(2), F.lit(10)).alias("x"))
    assert tuple(df.first().x) == (Decimal(200), Decimal(730), Decimal(173), Decimal(1103))


def test_cluster_ratio(spark):
    rows = [("g", i, float(i % 2), 1.0) for i in range(400)] + [("one", 1, 1.0, 4.0), ("none", 1, 1.0, 0.0)]
    out = {r.g: r for r in resampling.cluster_ratio(spark.createDataFrame(rows, "g string, c int, a double, b double"), ["g"], "c", "a", "b", 400).collect()}
    assert set(out) == {"g", "one"} and out["g"].ratio == 0.5 and out["g"].clusters == 400
    assert 0.43 < out["g"].low < 0.47 and 0.53 < out["g"].high < 0.57  # 1.96 standard errors are 0.049
    assert (out["one"].ratio, out["one"].low, out["one"].high) == (0.25, 0.25, 0.25)


MERGES = [
        ("sc|n=4\nb|2|red\n-\nd|3|red\nf|6|red", ("sc|n=6\na|1|red\nb|2|red\nd|3|red\ne|9|red\nf|6|red", [3, 5, 6, 8], [4], [])),
        ("b|y|red\nc|2|red\nd|3|red\na|1|red", ("sc|n=6\na|1|red\nb|x|red\nc|2|red\nd|3|red\ne|9|red", [4, 5, 6], [8], [3])),
        ("sc|n=1\na|7|red", ("sc|n=6\na|1|red\nb|x|red\nc|2|blue\nd|3\nx|red\ne|9|red\nf|q|red", [], [], [3, 4, 5, 6, 8])),
        ("```\nsc|n=4\nb|2|red\nb|2|red\nb|5|red\n\n```", ("sc|n=6\na|1|red\nb|2|red\nd|3\nx|red\ne|9|red\nf|q|red", [3], [4], [5, 6, 8])),
        (None, ("sc|n=6\na|1|red\nb|x|red\nc|2|blue\nd|3\nx|red\ne|9|red\nf|q|red", [], [], [3, 4, 5, 6, 8])),
    ]


def test_merge(spark):
    """One document for each answer, and two whose header is corrected."""
    heads = [("sc|k\na|1|red", "sc|n=1\nsc|n=1", ("sc|n=1\na|1|red", [1], [], [])), ("sc|k\na|1|red", "sc|n=1\nsc|k=x", ("sc|k\na|1|red", [], [], [1]))]
    every = [*((DOC, answer, want) for answer, want in MERGES), *heads]
    docs = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(every)], "doc_id long, text string")
    answers = spark.createDataFrame([(i, a) for i, (_, a, _) in enumerate(every)], "doc_id long, answer string")
    got = {r.doc_id: (r.text, r.replaced, r.dropped, r.unresolved) for r in repair.merge(docs, answers, C).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(every)}


def test_requests_and_continuation(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "sc|n=3\na|1|red\nb|2"), (3, "sc|n=1\na|1|red")], "doc_id long, text string")
    r = {x.doc_id: x for x in repair.requests(docs, C).collect()}
    assert set(r) == {1, 2} and r[1]["items"] == 4 and "[L5-L6] d|3 / x|red  <- E05, E05" in r[1].prompt and r[1].hint == 92
    more = spark.createDataFrame([(2, "sc|n=2\nb|2|red\nc|3|red"), (3, "zz|9|red")], "doc_id long, answer string")
    got = {x.doc_id: (x.text, x.code) for x in repair.continued(docs, more, C).collect()}
    assert got[2] == ("sc|n=3\na|1|red\nb|2|red\nc|3|red", None) and got[3] == ("sc|n=1\na|1|red", None) and got[1][1] == "D_EXPECTED_COUNT"


def test_merge_reads_a_text_once(spark):
    """However many steps use a document's text, it is made and extracted once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    docs = spark.createDataFrame([(i, DOC) for i in range(4)], "doc_id long, text string")
    answers = spark.createDataFrame([(i, MERGES[0][0]) for i in range(4)], "doc_id long, answer string")
    got = repair.merge(docs.select("doc_id", counted("text").alias("text")), answers, C).collect()
    assert {r.text for r in got} == {MERGES[0][1][0]} and read.value == 4
