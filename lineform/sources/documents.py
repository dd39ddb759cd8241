"""Reading and writing directories of documents, samples of other formats, and evidence tables."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineform.contract import Contract, Registry
from lineform.operators import documents


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of every file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_contract(spark: SparkSession, path: str, contract: Contract, strict: bool = True) -> DataFrame:
    return documents.decode(read_directory(spark, path), contract, strict)


def routed(docs: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """The documents of each registered prefix, by what their first line names."""
    prefix = documents.detect_prefix(F.col("text"))
    return {p: docs.where(prefix == p) for p in registry.contracts}


def write_documents(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Documents as JSON lines, a row for each, so that many share a file and line breaks stay; ``read_documents`` reads them."""
    docs.select(F.col(key).cast("string").alias("doc_id"), "text").write.json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, text string").json(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    """Records of XML files, an element named ``row`` for each: attributes as _name, repeated tags as arrays."""
    reader = spark.read.format("xml").option("rowTag", row).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).load(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole rows of a file of JSON lines; torn and bad ones are dropped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV or TSV sample, all columns as text; a header name that is empty or used twice is an error."""
    first = spark.read.text(path).first()
    names = next(csv.reader([first[0]], delimiter=separator), []) if first else []
    if not names or any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise ValueError("the header needs distinct names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(path, header=True, sep=separator, mode="FAILFAST", escape='"', multiLine=True)


def write_evidence(frames: list[DataFrame], path: str) -> DataFrame:
    """Writes rows of several frames as one CSV table: columns in the order in which they first appear, missing cells empty."""
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    every.write.csv(path, header=True, emptyValue="", nullValue="")
    return every


def html_text(html: Column) -> Column:
    """Text of a page: skipped elements and tags are dropped, entities of mark-up resolved, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(new))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"[\s ]+", " "))
