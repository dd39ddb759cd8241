import json

import pytest
from pyspark.sql import functions as F

from lineform.operators import domain as D

ROWS = [{"id": i, "site": {"code": "abcdefgh", "n": i / 2}, "kind": ["planned work", "emergency", "planned work"][i % 3], "memo": None if i % 4 else "a|b\\c\nd", **({"tags": ["x", None, {"k": 1}]} if i % 2 else {}), "any": [1, "t", {"q": [True]}][i % 3]} for i in range(12)]
DOCS = [(1, {"meta": {"by": "é", "page": 1}, "rows": ROWS}), (2, {"meta": {"by": "?", "page": 2}, "rows": ROWS[:2]}), (3, {"meta": {"by": "", "page": 3}, "rows": []})]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, json.dumps(d)) for k, d in DOCS], "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))


@pytest.fixture(scope="module")
def contract(docs):
    return D.infer_domain(docs, "w")


def test_inference(contract):
    assert contract.record_path == ("rows",)
    by = {c["name"]: (c["schema"]["type"], c["optional"], c["schema"].get("nullable", False)) for c in contract.columns}
    assert by == {"any": ("json", False, False), "id": ("integer", False, False), "kind": ("string", False, False), "memo": ("string", False, True), "site/code": ("string", False, False), "site/n": ("number", False, False), "tags": ("array", True, False)}
    assert D.json_schema(contract.row)["properties"]["memo"]["type"] == ["string", "null"]


def test_round_trip(docs, contract):
    written = D.encode(docs, contract)
    text = {r.doc_id: r.text for r in written.collect()}
    head = text[1].split("\n")[0]
    assert head.startswith(f"w|v=1|n=12|h={contract.schema_id}|m=") and '|d=[[4,"abcdefgh"]]' in head and '|e=[[2,["planned work","emergency"]]]' in head
    assert len(text[1].split("\n")) == 13 and text[3].count("\n") == 0
    back = {}
    for r in D.decode_records(written, contract).orderBy("doc_id", "line").collect():
        back.setdefault(r.doc_id, []).append(json.loads(r.json))
    assert back == {k: d["rows"] for k, d in DOCS if d["rows"]}
    plain = D.encode(docs, contract, shared=False, dictionaries=False)
    assert D.decode_records(plain, contract).count() == 14 and "|d=" not in plain.where("doc_id = 1").first().text
    assert D.diagnose(written, contract).where("NOT ok").count() == 0


def test_faults(spark, contract):
    bad = [{"meta": {"by": "x", "page": "1"}, "rows": []}, {"meta": {"by": "x"}, "rows": []}, {"meta": {"by": "x", "page": 1, "z": 0}, "rows": []}, {"meta": {"by": "x", "page": 1}, "rows": [None]}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bad)], "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    assert [r.code for r in D.faults(df, contract).orderBy("doc_id").collect()] == ["D_TYPE", "D_REQUIRED", "D_UNKNOWN", "D_TYPE"]
    assert D.encode(df, contract).count() == 0


def first_code(spark, contract, text):
    return [(e.line, e.code) for e in D.diagnose(spark.createDataFrame([(1, text)], "doc_id long, text string"), contract).first().errors]


def test_reading_faults(spark):
    c = D.Domain("p", {"type": "array", "items": {"type": "object", "fields": [{"name": "a", "optional": False, "schema": {"type": "integer"}}, {"name": "b", "optional": True, "schema": {"type": "string", "nullable": True}}]}})
    h = f"p|v=1|n=2|h={c.schema_id}"
    cases = {
        f"{h}\n1|x\n2|?": [],
        f"{h}\n1|x\n2|~\n": [],
        f"{h}\n1|x": [(1, "D_COUNT")],
        f"{h}\r\n1|x": [(1, "D_ENVELOPE")],
        "": [(1, "D_HEADER")],
        f"q|v=1|n=0|h={c.schema_id}": [(1, "D_PREFIX")],
        "p|v=1|n=0|h=0": [(1, "D_CONTRACT")],
        f"p|v=1|n=x|h={c.schema_id}": [(1, "D_COUNT")],
        f"p|v=1|n=0|n=0|h={c.schema_id}": [(1, "D_HEADER")],
        f"p|v=1|n=0|h={c.schema_id}|m=[]": [(1, "D_HEADER")],
        f'{h}|d=[[9,"x"]]\n1\n2': [(1, "D_HEADER")],
        f"{h}\n1|x\\q\n2|y": [(2, "D_ESCAPE")],
        f"{h}\n1\n2|y": [(2, "D_ARITY")],
        f"{h}\nx|y\n2.5|y": [(2, "D_VALUE"), (3, "D_TYPE")],
        f"{h}\n?|y\n~|y": [(2, "D_REQUIRED"), (3, "D_TYPE")],
        f'{h}|e=[[1,["u","v"]]]\n1|1\n2|2': [(3, "D_ENUM")],
        f'{h}\n1|"x\n2|"q|r': [(2, "D_VALUE"), (3, "D_ARITY")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: [(e.line, e.code) for e in r.errors] for r in D.diagnose(df, c).collect()}
    assert got == dict(enumerate(cases.values()))


def test_repair(spark):
    c = D.Domain("p", {"type": "array", "items": {"type": "object", "fields": [{"name": "a", "optional": False, "schema": {"type": "integer"}}]}})
    good = f"p|v=1|n=2|h={c.schema_id}\n1\n2"
    texts = ["﻿" + good.replace("\n", "\r\n"), f"```mini\n{good}\n```\n", f"```\n{good}", good + "\n\n\n", good]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.transport_repaired(F.col("t"))).collect()] == [good, good, good, good + "\n", good]
    docs = spark.createDataFrame([(i, good.replace("\n2", "\nx")) for i in range(5)], "doc_id long, text string")
    new = spark.createDataFrame([(0, 3, "2"), (1, 2, "2"), (2, 3, "2\n3"), (3, 3, "y")], "doc_id long, line int, new string")
    got = {r.doc_id: (r.code, r.text == good) for r in D.apply_replacements(docs, new, c).collect()}
    assert got == {0: (None, True), 1: ("D_REPAIR", False), 2: ("D_REPAIR", False), 3: ("D_VALUE", False), 4: ("D_REPAIR", False)}


def test_contract_checks(spark):
    with pytest.raises(D.DomainError):
        D.Domain("1", {"type": "array", "items": {"type": "json"}})
    with pytest.raises(D.DomainError):
        D.Domain("p", {"type": "json"}, ("x",))
    one = spark.createDataFrame([(1, '{"a":1}')], "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    c = D.infer_domain(one, "p")
    assert c.record_path is None and [r.json for r in D.decode_records(D.encode(one, c), c).collect()] == ['{"a":1}']


def test_a_document_is_judged_and_read_once(spark):
    """A fault looks at whole schemas only for scalars; lines come from one reading of the text."""
    text, number = {"type": "string"}, {"type": "number"}
    row = {"type": "object", "fields": [{"name": n, "optional": False, "schema": x} for n, x in (("s", text), ("x", number))]}
    domain = D.Domain("q", {"type": "object", "fields": [{"name": "rows", "optional": False, "schema": {"type": "array", "items": row}}]}, ("rows",))
    texts = ['{"rows":[{"s":"a","x":1},{"s":"b","x":2.5}]}', '{"rows":[{"s":1,"x":1}]}', '{"rows":{}}', "[]", "null", '{"rows":null}', '{"rows":[{"s":"a"}]}', '{"rows":[],"y":1}', "{}", '{"rows":[{"s":"a","x":"1"},{}]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, j string").select("doc_id", F.parse_json("j").alias("v"))
    code = D.fault(F.col("v"), domain.schema)
    assert [x[0] for x in docs.orderBy("doc_id").select(code).collect()] == [None, "D_TYPE", "D_TYPE", "D_TYPE", "D_TYPE", "D_TYPE", "D_REQUIRED", "D_UNKNOWN", "D_REQUIRED", "D_TYPE"]
    assert str(code).count("schema_of_variant") == 2
    wire = spark.createDataFrame([(1, "q|v=1")], "doc_id long, text string")
    plan = D.read_lines(wire, domain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
