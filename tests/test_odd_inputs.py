"""Queries against their SQL on rows that the driver's tables rarely have."""

import duckdb

from lineform.plans import catalog

TEXTS = [None, "", " ", "\t \n", "\r\n", "\x0b", "\xa0x", "x ", " \x0bx ", "x\x85\t", "\x1f", "　", '"', '""', '"x"', "", "\\", "a|b\\n\n", "﻿x", "​x"]


def test_decode_roundtrip_of_any_text(spark, tmp_path):
    """Empty, null and white texts come back, with repeated and null ids."""
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, "again"), (3, ""), (None, "without id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "decode_roundtrip_documents"
    got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select("id", "digest").collect()]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=str) == sorted(c.sql(f"SELECT id, digest FROM ({catalog.oracle_sql()[name]})").fetchall(), key=str)
