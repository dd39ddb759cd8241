import pytest
from pyspark.sql import functions as F

from lineform.contract import Contract, Field, Registry
from lineform.sources import documents as S


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x|n=1\n1"), ("b", 'y|n=0\r\n"'), ("c", None)], "doc_id string, text string")
    S.write_documents(docs, str(tmp_path / "d"))
    assert sorted(map(tuple, S.read_documents(spark, str(tmp_path / "d")).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.txt").write_text("x|n=1\n1")
    assert S.read_contract(spark, str(tmp_path / "f"), Contract("x", (Field("k", "int"),))).first().k == 1
    found = S.routed(docs.where("text IS NOT NULL"), Registry((Contract("x", (Field("k"),)), Contract("y", (Field("k"),)))))
    assert {p: df.count() for p, df in found.items()} == {"x": 1, "y": 1}


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a,b",c\n1,"x\ny"\n')
    df = S.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a,b", "c"] and tuple(df.first()) == ("1", "x\ny")
    for bad in ("a,a\n1,2\n", "a,\n1,2\n", ""):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            S.read_table(spark, str(tmp_path / "bad.csv"))
    every = S.write_evidence([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")], str(tmp_path / "e"))
    assert every.columns == ["a", "b", "c"] and spark.read.csv(str(tmp_path / "e"), header=True).count() == 2


def test_xml_and_json_lines(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<all><r k="1"><v>a</v><v>b</v></r><r k="2"><v>c</v></r></all>')
    rows = S.read_xml(spark, str(tmp_path / "x.xml"), "r").orderBy("_k").collect()
    assert [(r["_k"], r["v"]) for r in rows] == [(1, ["a", "b"]), (2, ["c"])]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a":')
    assert sorted(r.a for r in S.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]


def test_html(spark):
    df = spark.createDataFrame([("<p>a&amp;b<script>x</script><!-- no --> c</p>",)], "h string")
    assert df.select(S.html_text(F.col("h"))).first()[0] == "a&b c"
