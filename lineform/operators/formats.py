"""The same records in several formats, and their sizes; tables and event streams as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineform.contract import Contract
from lineform.operators import documents as D

FORMATS = ("json", "json_pretty", "csv", "tsv", "xml", "yaml", "markdown", "wire")


def _texts(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def _quoted(text: Column, separator: str) -> Column:
    special = text.contains('"') | text.contains(separator) | text.contains("\n") | text.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _xml(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _json_value(c: str) -> Column:
    """A column's JSON value."""
    return F.regexp_replace(F.to_json(F.array(F.col(c))), r"\A\[|\]\z", "")


def record_texts(columns: list[str], contract: Contract) -> dict[str, tuple[str, Column, str, str]]:
    """For each format what comes before the records, a record's text, what is between two, and what comes after."""
    texts = _texts(columns)
    pairs = [(F.lit(c), t, _json_value(c)) for c, t in zip(columns, texts, strict=True)]
    cell = lambda t: F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    wire = F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (D._encoded(f, contract) for f in contract.core)))
    key = contract.records_key
    return {
        "json": (f'{{"{key}":[', F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit('"'), n, F.lit('":'), j) for n, _, j in pairs)), F.lit("}")), ",", "]}"),
        "json_pretty": (f'{{\n  "{key}": [\n', F.concat(F.lit("    {\n"), F.concat_ws(",\n", *(F.concat(F.lit('      "'), n, F.lit('": '), j) for n, _, j in pairs)), F.lit("\n    }")), ",\n", "\n  ]\n}"),
        "csv": (",".join(columns) + "\n", F.concat_ws(",", *(_quoted(t, ",") for t in texts)), "\n", "\n"),
        "tsv": ("\t".join(columns) + "\n", F.concat_ws("\t", *(_quoted(t, "\t") for t in texts)), "\n", "\n"),
        "xml": (f"<{key}>", F.concat(F.lit("<r>"), *(F.concat(F.lit("<"), n, F.lit(">"), _xml(t), F.lit("</"), n, F.lit(">")) for n, t, _ in pairs), F.lit("</r>")), "", f"</{key}>"),
        "yaml": (f"{key}:\n", F.concat(F.lit("- "), F.concat_ws("\n  ", *(F.concat(n, F.lit(": "), j) for n, _, j in pairs))), "\n", "\n"),
        "markdown": ("| " + " | ".join(columns) + " |\n|" + "-|" * len(columns) + "\n", F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(t) for t in texts)), F.lit(" |")), "\n", "\n"),
        "wire": (f"{contract.prefix}|n=", wire, "\n", "\n"),
    }


def sizes(df: DataFrame, contract: Contract, key: str) -> DataFrame:
    """key, records, a column of bytes for each format, and saving: how much smaller the wire format is than compact JSON.

    Sizes are sums over records, with what comes before, between and after them; no document is put together.
    """
    columns = [f.name for f in contract.core]
    formats = record_texts(columns, contract)
    n = F.count("*")
    by = df.groupBy(key).agg(n.alias("records"), *(F.sum(F.octet_length(t)).alias(f) for f, (_, t, _, _) in formats.items()))
    total = lambda f: F.col(f) + len(formats[f][0].encode()) + len(formats[f][3].encode()) + len(formats[f][2]) * (F.col("records") - 1)
    wire = total("wire") + F.length(F.col("records").cast("string")) + 1
    out = by.select(key, "records", *((wire if f == "wire" else total(f)).alias(f) for f in formats))
    return out.withColumn("saving", F.round(1 - F.try_divide("wire", "json"), 6))


def table_text(df: DataFrame, key: str, columns: list[str], order: list[str], contract: Contract, fmt: str = "markdown") -> DataFrame:
    """key, text: the records of a document in a format other than wire."""
    before, text, between, after = record_texts(columns, contract)[fmt]
    by = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))).alias("x"))
    return by.select(key, F.concat(F.lit(before), F.array_join(F.transform("x", lambda x: x["__t"]), between), F.lit(after)).alias("text"))


def fence_stripped(text: Column) -> Column:
    """A text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```[A-Za-z0-9_-]*[ \t]*\r?\n", ""), r"\r?\n```\s*\z", "")


def strict_json(text: Column) -> Column:
    """A text as a variant; null unless it is JSON without NaN, Infinity and repeated keys."""
    return F.try_parse_json(text)


def naive_pipes(line: Column) -> Column:
    """Cells of a line without regard to escapes."""
    return F.transform(F.split(line, r"\|", -1), lambda x: F.trim(x))


def server_events(streams: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, index, event, data: the events of a text/event-stream; data lines are joined, comments and events without data skipped."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "^\\x{feff}", ""), r"\r\n?", "\n")
    blocks = streams.select(key, F.posexplode(F.split(plain, r"\n\n+", -1)).alias("index", "b"))
    lines = F.split("b", "\n")
    value = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":") | (x == name)), lambda x: F.regexp_replace(F.substring(x, F.lit(len(name) + 2), F.length(x)), r"\A ", ""))
    out = blocks.select(key, "index", F.coalesce(F.get(F.reverse(value("event")), 0), F.lit("message")).alias("event"), value("data").alias("d"))
    return out.where(F.size("d") > 0).select(key, "index", "event", F.array_join("d", "\n").alias("data"))
