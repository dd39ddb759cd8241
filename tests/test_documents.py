import pytest
from pyspark.sql import functions as F

from lineform.contract import Contract, ContractError, Field, Registry
from lineform.operators import documents as D

SC = Contract("sc", (Field("id", unique=True), Field("qty", "int", low=0, high=100), Field("ratio", "float", low=-1, high=1), Field("flag", "bool"), Field("color", "enum", values=("red", "green"))), (Field("memo", optional=True), Field("extra", "int", optional=True)))
LS = Contract("ls", (Field("id"), Field("xs", "list", low=1, high=3), Field("ks", "list", item="int", count_key="k"), Field("ms", "mlist"), Field("pt", "tuple", parts=(Field("x", "int"), Field("y", "float"), Field("tag", optional=True)))), header=(Field("k", "int", optional=True),))


def codes(spark, contract, text):
    row = D.diagnostics(spark.createDataFrame([(1, text)], "doc_id long, text string"), contract).first()
    return [(e.code, e.line) for e in row.errors]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sc|n=1\na|1|0.5|true|red\n", []),
        ("﻿\r\nsc|n=1\r\n\r\na|1|0.5|1|green|x\\|y\r\n", []),
        ("", [("E01", 0)]),
        ("xx|n=0", [("E02", 1)]),
        ("sc", [("E03", 1)]),
        ("sc|n=abc\n", [("E06", 1)]),
        ("sc|n=2\na|1|0|0|red", [("E04", 0)]),
        ("sc|n=1\na|1|0|0", [("E05", 2)]),
        ("sc|n=1|v=2\na|1|0|0|red|m|1|more", []),
        ("sc|n=1\na|1|0|0|red|m|1|more", [("E05", 2)]),
        ("sc|n=1\na|x|0|0|red", [("E06", 2)]),
        ("sc|n=1\na|+5|.5|yes|red", [("E06", 2)] * 3),
        ("sc|n=1\na|1|0|0|blue", [("E10", 2)]),
        ("sc|n=1\na|101|0|0|red", [("E13", 2)]),
        ("sc|n=1\na\\q|1|0|0|red", [("E09", 2)]),
        ("sc|n=1\na|1|0|0|red\\", [("E09", 2)]),
        ("sc|n=2\na|1|0|0|red\na|2|0|0|red", [("E11", 3)]),
        ("sc|n=2\na|x|0|0|red\na|2|0|0|red", [("E06", 2)]),
        ("sc|n=0|bad", [("E12", 1)]),
        ("sc|n=0|n=1", [("E12", 1)]),
    ],
)
def test_error_codes(spark, text, want):
    assert codes(spark, SC, text) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('a|x,"y,z"|1,2|p*,q|1,2.5,', []),
        ("a||1,2|p*,q|1,2,t", [("E07", 2)]),
        ("a|x|1|p*,q|1,2,t", [("E07", 2)]),
        ("a|x|1,y|p*,q|1,2,t", [("E06", 2)]),
        ("a|x|1,2|p,q|1,2,t", [("E08", 2)]),
        ("a|x*|1,2|p*,q|1,2,t", [("E08", 2)]),
        ('a|"x|1,2|p*|1,2,t', [("E09", 2)]),
        ("a|x|1,2|p*|1,2", [("E07", 2)]),
    ],
)
def test_lists(spark, line, want):
    assert codes(spark, LS, f"ls|n=1|k=2\n{line}") == want


def test_round_trip(spark):
    nasty = ["a|b\\c\nd", '"q', "x*", "a,b", "", "é", "\\n"]
    rows = [(1, i, f"r{i}", [s, "z"], [1, 2], [s, "w"], i % 2, (i, i / 3, s or None)) for i, s in enumerate(nasty)]
    df = spark.createDataFrame(rows, "doc_id long, i int, id string, xs array<string>, ks array<long>, ms array<string>, selected int, pt struct<x:long,y:double,tag:string>")
    docs = D.encode(df, LS, ["i"], k=F.lit(2))
    assert D.verified(docs, LS).count() == 0
    back = D.decode(docs, LS).orderBy("line").collect()
    assert [(r.id, r.xs, r.ks, r.ms, r.selected, tuple(r.pt)) for r in back] == [tuple(r[2:7]) + (r[7],) for r in rows]
    head = D.headers(docs, LS).first()
    assert (head.prefix, head.n, head.v, head.header.k) == ("ls", 7, 1, 2)


def test_lenient_and_strict(spark):
    docs = spark.createDataFrame([(1, "sc|n=2\na|1|0|0|red\nb|x|0|0|red"), (2, "sc|n=1\nc|1|0|0|red"), (3, None)], "doc_id long, text string")
    assert sorted(r.id for r in D.decode(docs, SC, strict=False).collect()) == ["a", "c"]
    assert [r.id for r in D.decode(docs, SC).collect()] == ["c"]


def test_contracts():
    for bad in (lambda: Contract("1x", (Field("a"),)), lambda: Contract("x", ()), lambda: Contract("x", (Field("a", "enum"),)), lambda: Contract("x", (Field("a"), Field("a")))):
        with pytest.raises(ContractError) as e:
            bad()
        assert e.value.code == "E20"
    base = Contract("b", (Field("a"),))
    assert Registry((base, Contract("c", (Field("a"),), (Field("z", optional=True),), parent="b"))).lineage("c") == ["c", "b"]
    with pytest.raises(ContractError) as e:
        Registry((base, Contract("c", (Field("z"),), parent="b")))
    assert e.value.code == "E21"


def test_strict_reading_parses_once(spark):
    """A strict filter that sinks below the parse makes all lines anew for each of its hundreds of uses."""
    docs = spark.createDataFrame([(1, "sc|n=1\na|1|0|0|red"), (2, "sc|n=2\na|1|0|0|red"), (3, "sc|n=1\na|x|0|0|red"), (4, "sc|n=0")], "doc_id long, text string")
    read = D.decode(docs, SC)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("split(coalesce") < 10
    assert [r.doc_id for r in read.collect()] == [1]


def test_lists_of_integers(spark):
    """Short ways for plain cells give what the long ones give; a text list takes the long one."""
    cells = ["1", "-1,2", "1, 2", " 1,2 ", "1,,2", "1,2*", '"1",2', "999999999999999999,1", "9223372036854775807", "9223372036854775808", "1.5", "007,-0", "1,2,3,4", ""]
    contract = lambda item: Contract("p", (Field("id"), Field("xs", "list", item=item, low=1, high=3)))
    docs = spark.createDataFrame([(1, f"p|n={len(cells)}\n" + "\n".join(f"a|{c}" for c in cells))], "doc_id long, text string")
    rows = [{r.line: r for r in D.records(docs, contract(item)).collect()} for item in ("int", "str")]
    fits = lambda x: x.removeprefix("-").isdigit() and -(2**63) <= int(x) < 2**63
    for i, cell in enumerate(cells):
        got, text = rows[0][i + 2], rows[1][i + 2]
        want = [e.code for e in text.errors] or ([] if all(map(fits, text.record.xs)) else ["E06"])
        assert [e.code for e in got.errors] == want and (want or got.record.xs == [int(x) for x in text.record.xs]), cell


def test_white_space_at_ends(spark):
    texts = ["x", " x\t", "x　", "\xa0é\xa0", "é", "x  ", "\x1c", "", "a\\|b\\\\n "]
    contract = Contract("w", (Field("a"), Field("b", optional=True)))
    docs = spark.createDataFrame([(i, f"w|n=1\n{t.replace(chr(92), chr(92) * 2).replace('|', chr(92) + '|')}|z") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.record.a for r in D.records(docs, contract).collect()}
    assert [found[i] for i in range(len(texts))] == [t.strip() or None for t in texts]
