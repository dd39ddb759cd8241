import pytest

from lineform.contract import Contract, Field
from lineform.operators import documents as D
from lineform.streaming.reader import StreamReader, read_stream

C = Contract("sc", (Field("id", unique=True), Field("q", "int")), (Field("memo", optional=True),))
TEXT = "﻿sc|n=5\r\né|1|x\\|y\n\nb|2\né|3\nb|x\nç|4"
FRAGMENTS = "doc string, seq int, data binary, last boolean"


def batch_rows(spark, text):
    rows = D.records(spark.createDataFrame([("d", text)], "doc_id string, text string"), C).orderBy("line").collect()
    return [(r.line, None if r.errors else r.record.asDict(), [e.code for e in r.errors]) for r in rows]


def streamed(rows):
    return [(r.line, None if r.errors else r.record.asDict(), [e.code for e in r.errors]) for r in rows]


def cut(text, n):
    data = text.encode()
    return [data[i : i + n] for i in range(0, len(data), n)]


@pytest.mark.parametrize("n", [7, 40])
def test_fragments_give_what_the_whole_gives(spark, tmp_path, n):
    parts = cut(TEXT, n)
    rows = [("d", i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    reader = StreamReader(spark, C, str(tmp_path))
    found = []
    for i in range(0, len(rows), 3):
        group = rows[i : i + 3]
        found += reader.push(spark.createDataFrame(group[::-1] + group[:1], FRAGMENTS)).orderBy("line").collect()
    assert streamed(found) == batch_rows(spark, TEXT)
    assert [r["index"] for r in found] == [0, 1, None, None, 2]
    r = reader.results().first()
    assert (r.expected, r.received, r.valid, r.missing, r.excess, r.terminated, r.truncated, r.complete) == (5, 5, 3, 0, 0, False, False, False)


def test_late_fragments_and_broken_ends(spark, tmp_path):
    reader = StreamReader(spark, C, str(tmp_path))
    assert reader.push(spark.createDataFrame([("a", 1, bytearray(b"1\nb|2\n"), False), ("b", 0, bytearray(b"sc|n=2\na|1\nb"), True)], FRAGMENTS)).where("doc = 'a'").count() == 0
    got = reader.push(spark.createDataFrame([("a", 0, bytearray(b"sc|n=3\na|"), False)], FRAGMENTS)).collect()
    assert sorted(r.record.id for r in got) == ["a", "b"]
    again = reader.push(spark.createDataFrame([("a", 0, bytearray(b"sc|n=9\n"), False), ("a", 2, bytearray(b"a|7\n"), True)], FRAGMENTS)).collect()
    assert [[e.code for e in r.errors] for r in again] == [["E11"]]
    out = {r.doc: (r.expected, r.received, r.valid, r.missing, r.terminated, r.truncated, r.complete) for r in reader.results().collect()}
    assert out == {"a": (3, 3, 2, 0, True, False, False), "b": (2, 2, 1, 0, False, True, False)}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for i, p in enumerate(cut(TEXT, 30)):
        spark.createDataFrame([("d", i, bytearray(p), (i + 1) * 30 >= len(TEXT.encode()))], FRAGMENTS).coalesce(1).write.mode("append").parquet(str(source))
    reader = StreamReader(spark, C, str(tmp_path / "state"))
    query = read_stream(spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", 1).parquet(str(source)), reader, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("line").collect()
    assert streamed(rows) == batch_rows(spark, TEXT)
