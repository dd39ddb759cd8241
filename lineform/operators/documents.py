"""Documents of a contract: text to typed records with errors by line, and records back to text.

Decoding is one narrow pass: the header is a document's first significant line, every other one becomes a row
with its values and an array of errors. Each cell is split once and gives one struct. Rows carry what their header
says, so that strict reading and diagnostics need one shuffle by document and no second parse. Uniqueness of one
field is a window by document and value; of several, rows are folded in line order, as only accepted records claim
their values. Encoding groups the records of each document once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineform.contract import Contract, Field
from lineform.functions import lexical as L
from lineform.functions import scalars as S

ERROR = "struct<code:string,field:string>"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the array ``lines`` of significant lines: structs (line, text), numbered as they stand."""
    given = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(given.startswith("\ufeff"), F.regexp_replace(given, "^\\x{feff}", "")).otherwise(given)
    every = F.transform(F.split(whole, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.when(x.endswith("\r"), F.rtrim(x, F.lit("\r"))).otherwise(x).alias("text")))
    return docs.withColumn("lines", F.filter(every, lambda x: ~L.is_blank(x["text"])))


def detect_prefix(text: Column) -> Column:
    """The prefix that a document's first significant line names."""
    whole = F.regexp_replace(text, "^\\x{feff}", "")
    first = F.get(F.filter(F.split(whole, "\n", -1), lambda x: ~L.is_blank(x)), 0)
    return L.restored(L.trimmed(F.substring_index(L.shielded(first), "|", 1)))


def _scalar(cell: Column, f: Field) -> Column:
    """struct(value, code) of a shielded cell."""
    bad = "E10" if f.type == "enum" else "E06"

    def typed(text: Column) -> Column:
        value, ok = S.parsed(text, f, f.type)
        return F.struct(value.alias("value"), ok.alias("ok"))

    def judged(v: Column) -> Column:
        code = F.when(~v["ok"], bad)
        if f.type in ("int", "float", "date", "decimal") and (f.low is not None or f.high is not None):
            code = code.when(~S.in_range(v["value"], f), "E13")
        return F.struct(F.when(code.isNull(), v["value"]).alias("value"), code.alias("code"))

    nothing = F.struct(F.lit(f.default if f.optional else None).cast(f.spark_type()).alias("value"), F.lit(None if f.optional else "E06").cast("string").alias("code"))
    return F.when(cell == "", nothing).otherwise(L.bound(L.bound(L.restored(cell), typed), judged))


def _list(cell: Column, f: Field, counts: Column | None, separator: str) -> Column:
    """struct(value, picked, code) of a shielded cell; the first fault counts: quotes, size, items, marks."""

    def judged(x: Column) -> Column:
        def item(e: Column) -> Column:
            value, ok = S.parsed(e["text"], f, f.item)
            return F.struct(value.alias("value"), ok.alias("ok"))

        def whole(v: Column) -> Column:
            typed, marks = v["typed"], v["marks"]
            n, m = F.size(typed), F.size(marks)
            size_ok = F.lit(True)
            if f.low is not None:
                size_ok = size_ok & (n >= f.low)
            if f.high is not None:
                size_ok = size_ok & (n <= f.high)
            if counts is not None:
                size_ok = size_ok & F.coalesce(n == counts, F.lit(True))
            rule = {"exactly_one": m == 1, "at_least_one": m >= 1, "at_most_one": m <= 1, "any": F.lit(True)}[f.marker] if f.type == "mlist" else m == 0
            code = F.when(~x["whole"], "E09").when(~size_ok, "E07").when(~F.forall(typed, lambda t: t["ok"]), "E10" if f.item == "enum" else "E06").when(~rule, "E08")
            picked = F.get(marks, 0) if f.marker in ("exactly_one", "at_most_one") else marks
            return L.bound(code, lambda c: F.struct(F.when(c.isNull(), F.transform(typed, lambda t: t["value"])).alias("value"), F.when(c.isNull(), picked).alias("picked"), c.alias("code")))

        marks = F.filter(F.transform(x["elements"], lambda e, i: F.when(e["marked"], i)), lambda i: i.isNotNull())
        return L.bound(F.struct(F.transform(x["elements"], item).alias("typed"), marks.alias("marks")), whole)

    none = F.struct(F.array().cast("array<struct<text:string,marked:boolean>>").alias("elements"), F.lit(True).alias("whole"))
    found = L.bound(F.when(cell == "", none).otherwise(L.elements_of(cell, separator)), judged)
    if f.type == "list" and f.item == "int" and not separator.isdigit() and separator != "-":
        found = F.when(cell.rlike(_INTS.format(L._quoted(separator))), _integers(F.split(cell, L._quoted(separator), -1), f, counts)).otherwise(found)
    if not f.optional:
        return found
    nothing = F.struct(F.lit(f.default).cast(f.spark_type()).alias("value"), F.lit(None).cast("int" if f.marker in ("exactly_one", "at_most_one") else "array<int>").alias("picked"), F.lit(None).cast("string").alias("code"))
    return F.when(cell == "", nothing).otherwise(found)


#: A list cell of integers that surely fit, without white space, quotes or marks.
_INTS = r"\A-?[0-9]{{1,18}}+(?:{0}-?[0-9]{{1,18}}+)*+\z"


def _integers(items: Column, f: Field, counts: Column | None) -> Column:
    """As by _list, of items all of which are integers: only the size can be at fault."""
    n = F.size(items)
    wrong = F.lit(False)
    if f.low is not None:
        wrong = wrong | (n < f.low)
    if f.high is not None:
        wrong = wrong | (n > f.high)
    if counts is not None:
        wrong = wrong | F.coalesce(n != counts, F.lit(False))
    picked = F.lit(None).cast("int") if f.marker in ("exactly_one", "at_most_one") else F.array().cast("array<int>")
    return F.struct(F.when(~wrong, items.cast("array<bigint>")).alias("value"), F.when(~wrong, picked).alias("picked"), F.when(wrong, "E07").alias("code"))


def _tuple(cell: Column, f: Field, separator: str) -> Column:
    """struct(value, code) of a shielded cell; parts are judged in order."""

    def judged(x: Column) -> Column:
        parts = F.struct(*(_scalar(F.coalesce(L.shielded_text(F.get(x["elements"], i)["text"]), F.lit("")), p).alias(p.name) for i, p in enumerate(f.parts)))

        def whole(v: Column) -> Column:
            faults = [F.when(F.get(x["elements"], i)["marked"], "E08").otherwise(v[p.name]["code"]) for i, p in enumerate(f.parts)]
            code = F.when(~x["whole"], "E09").when(F.size(x["elements"]) != len(f.parts), "E07").otherwise(F.coalesce(*faults))
            return L.bound(code, lambda c: F.struct(F.when(c.isNull(), F.struct(*(v[p.name]["value"].alias(p.name) for p in f.parts))).alias("value"), c.alias("code")))

        return L.bound(parts, whole)

    nothing = F.struct(F.lit(None).cast(f.spark_type()).alias("value"), F.lit(None if f.optional else "E07").cast("string").alias("code"))
    return F.when(cell == "", nothing).otherwise(L.bound(L.elements_of(cell, separator), judged))


def decoded_field(cell: Column, f: Field, separator: str, counts: Column | None = None) -> Column:
    """One struct of a cell: value, code, and for a marked list picked."""
    if f.type in ("list", "mlist"):
        return _list(cell, f, counts, separator)
    return _tuple(cell, f, separator) if f.type == "tuple" else _scalar(cell, f)


def headers(docs: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """docs' key, ``lines``, and the header: prefix, n, v, typed keys in ``header``, unknown ones in ``extras``, and ``header_errors`` in order: entries as they stand, missing keys, count, prefix."""
    sep = contract.separator
    numbered = lines(docs.select(key, "text"))
    first = F.get("lines", 0)
    entry = lambda x: F.struct(x.alias("text"), L.trimmed(F.substring_index(x, "=", 1)).alias("key"), L.trimmed(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"), x.contains("=").alias("whole"))
    at = numbered.withColumn("first", first["text"]).withColumn("cells", L.fields_of(L.shielded(F.col("first"), sep)))
    at = at.select(key, "lines", first["line"].alias("header_line"), L.restored(F.get("cells", 0), sep).alias("prefix"), F.filter(F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), entry), lambda e: e["text"] != "").alias("entries"), L.valid_escapes(F.col("first"), sep).alias("escapes"))
    value = lambda name: F.get(F.filter("entries", lambda e: e["whole"] & (L.restored(e["key"], sep) == name)), 0)["value"]
    fields = [Field("n", "int"), Field("v", "int"), *contract.header]
    given = at.withColumns({f"g_{f.name}": value(f.name) for f in fields})
    typed = given.withColumns({f"d_{f.name}": F.when(F.col(f"g_{f.name}").isNotNull(), decoded_field(F.col(f"g_{f.name}"), f, sep)) for f in fields})
    known = [f.name for f in fields]
    error = lambda code, name: F.struct(code.alias("code"), F.lit(name).alias("field"))

    def fault(e: Column, i: Column) -> Column:
        again = F.exists(F.slice("entries", F.lit(1), i), lambda o: o["whole"] & (o["key"] == e["key"]))
        code = F.when(~e["whole"] | again, "E12")
        for f in fields:
            code = code.when(e["key"] == f.name, F.col(f"d_{f.name}.code"))
        return F.struct(code.alias("code"), F.when(e["whole"], e["key"]).otherwise("").alias("field"))

    missing = [error(F.when(F.col(f"g_{f.name}").isNull(), "E12"), f.name) for f in contract.header if not f.optional]
    after = F.array(*missing, error(F.when(F.col("g_n").isNull(), "E03"), "n"), error(F.when(F.col("prefix") != contract.prefix, "E02"), ""))
    found = F.filter(F.concat(F.array(error(F.when(~F.col("escapes"), "E09"), "")), F.transform("entries", fault), after), lambda e: e["code"].isNotNull())
    errors = F.when(F.size("lines") > 0, found).otherwise(F.array(error(F.lit("E01"), "")))
    extra = F.filter("entries", lambda e: e["whole"] & ~L.restored(e["key"], sep).isin(*known))
    extras = F.aggregate(extra, F.create_map().cast("map<string,string>"), lambda done, e: F.when(F.map_contains_key(done, e["key"]), done).otherwise(F.map_concat(done, F.create_map(e["key"], L.restored(e["value"], sep)))))
    keys = [F.when(F.col(f"g_{f.name}").isNull(), F.lit(f.default).cast(f.spark_type())).otherwise(F.col(f"d_{f.name}.value")).alias(f.name) for f in contract.header]
    header = F.struct(*keys) if keys else F.struct(F.lit(None).cast("string").alias("_"))
    return typed.select(key, "lines", "header_line", "prefix", F.col("d_n.value").alias("n"), F.coalesce("d_v.value", F.lit(1)).alias("v"), header.alias("header"), extras.alias("extras"), errors.cast(f"array<{ERROR}>").alias("header_errors"))


def _parsed(docs: DataFrame, contract: Contract, key: str, outer: bool) -> DataFrame:
    """A row for each record line with its document's header_errors, header_line, n and total; outer: one row without a line for documents without records. cut: the line looks broken off."""
    top = headers(docs, contract, key).withColumn("rest", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))
    return unique_checked(typed(top, contract, key, outer), contract, key)


def typed(top: DataFrame, contract: Contract, key: str, outer: bool = False) -> DataFrame:
    """Of headers with ``rest``, the array of record lines: a row for each line, without a check of uniqueness."""
    sep = contract.separator
    spread = F.explode_outer("rest").alias("l")  # plain explode would test rest below all that makes it
    carried = [key, "header_errors", "header_line", "n"]
    # total comes before the rows are spread, as each of them would else hold all lines
    rows = top.withColumn("total", F.size("rest")).select(*carried, "total", "v", "header", spread).select(*carried, "total", "v", "header", F.col("l.line").alias("line"), F.col("l.text").alias("text"))
    rows = rows if outer else rows.where("line IS NOT NULL")
    rows = rows.withColumn("cells", F.when(L.valid_escapes(F.col("text"), sep), L.fields_of(L.shielded(F.col("text"), sep))))
    size, core, every = F.size("cells"), len(contract.core), len(contract.fields)
    short = size < core
    arity = short | ((size > every) & (F.col("v") <= contract.version))
    rows = rows.withColumns({"fatal": F.when(F.col("line").isNull(), F.lit("")).when(F.col("cells").isNull(), "E09").when(arity, "E05"), "cut": F.when(F.col("cells").isNull(), L.dangling(F.col("text"), sep)).otherwise(short)})
    header_names = {f.name for f in contract.header}
    struct_of = {}
    for i, f in enumerate(contract.fields):
        counts = F.col(f"header.{f.count_key}") if f.count_key in header_names else None
        struct_of[f"d_{i}"] = F.when(F.col("fatal").isNull(), decoded_field(F.coalesce(F.get("cells", i), F.lit("")), f, sep, counts))
    rows = rows.withColumns(struct_of)
    values, errors = [], [F.when(F.col("fatal") != "", F.struct(F.col("fatal").alias("code"), F.lit("").alias("field")))]
    for i, f in enumerate(contract.fields):
        values.append(F.col(f"d_{i}.value").alias(f.name))
        if f.type == "mlist":
            values.append(F.col(f"d_{i}.picked").alias(f.selection))
        errors.append(F.when(F.col(f"d_{i}.code").isNotNull(), F.struct(F.col(f"d_{i}.code").alias("code"), F.lit(f.name).alias("field"))))
    return rows.select(*carried, "total", "line", F.struct(*values).alias("record"), F.array_compact(F.array(*errors)).cast(f"array<{ERROR}>").alias("errors"), F.coalesce("cut", F.lit(False)).alias("cut"))


def claims_of(rows: DataFrame, contract: Contract, key: str) -> DataFrame:
    """key, field, value (as JSON text) of what accepted rows claim."""
    names = [f.name for f in contract.fields if f.unique]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.when(F.col(f"record.{n}").isNotNull(), F.to_json(F.struct(F.col(f"record.{n}").alias("v")))).alias("value")) for n in names)))
    return rows.where("size(errors) = 0 AND line IS NOT NULL").select(key, each.alias("c")).select(key, "c.*").where("value IS NOT NULL")


def unique_checked(out: DataFrame, contract: Contract, key: str, claimed: DataFrame | None = None) -> DataFrame:
    """Typed rows with E11 where an accepted row before them, or ``claimed`` (as by claims_of), has the value."""
    unique = [f.name for f in contract.fields if f.unique]
    for i, name in enumerate(unique if claimed is not None else []):
        old = claimed.where(F.col("field") == name).select(F.col(key).alias(f"k{i}"), F.col("value").alias(f"v{i}")).distinct()
        value = F.to_json(F.struct(F.col(f"record.{name}").alias("v")))
        again = F.array(F.struct(F.lit("E11").alias("code"), F.lit(name).alias("field"))).cast(f"array<{ERROR}>")
        out = out.join(old, F.col(key).eqNullSafe(F.col(f"k{i}")) & (value == F.col(f"v{i}")) & F.col(f"record.{name}").isNotNull(), "left")
        out = out.withColumn("errors", F.when(F.col(f"v{i}").isNotNull(), F.concat("errors", again)).otherwise(F.col("errors"))).drop(f"k{i}", f"v{i}")
    if len(unique) == 1:
        value = F.col(f"record.{unique[0]}")
        claims = F.min(F.when(F.size("errors") == 0, F.col("line"))).over(Window.partitionBy(key, value))
        twice = F.coalesce(value.isNotNull() & (claims < F.col("line")), F.lit(False))
        return out.withColumn("errors", F.when(twice, F.concat("errors", F.array(F.struct(F.lit("E11").alias("code"), F.lit(unique[0]).alias("field"))))).otherwise(F.col("errors")))
    return _claimed(out, unique, key) if unique else out


def _claimed(rows: DataFrame, unique: list[str], key: str) -> DataFrame:
    """E11 for several unique fields: rows of a document pass in line order; an accepted one claims all its values."""
    texts = F.array(*(F.to_json(F.struct(F.col(f"record.{n}").alias("v"))) for n in unique))
    nulls = F.array(*(F.col(f"record.{n}").isNotNull() for n in unique))
    brief = rows.where("line IS NOT NULL").select(F.col(key).cast("string").alias("k"), "line", (F.size("errors") == 0).alias("ok"), F.zip_with(texts, nulls, lambda t, there: F.when(there, t)).alias("vs"))
    by = brief.repartition("k").sortWithinPartitions("k", "line")

    def fold(frames):
        at, claims = object(), []
        for frame in frames:
            out = []
            for k, line, ok, vs in zip(frame["k"], frame["line"], frame["ok"], frame["vs"], strict=True):
                if k != at:
                    at, claims = k, [set() for _ in unique]
                again = [n for n, v, seen in zip(unique, vs, claims, strict=True) if v is not None and v in seen]
                if again:
                    out.append((k, line, again))
                elif ok:
                    for v, seen in zip(vs, claims, strict=True):
                        if v is not None:
                            seen.add(v)
            yield pd.DataFrame(out, columns=["k", "line", "again"])

    found = by.mapInPandas(fold, "k string, line int, again array<string>")
    joined = rows.join(found.withColumnRenamed("line", "at"), F.col(key).cast("string").eqNullSafe(F.col("k")) & (F.col("line") == F.col("at")), "left")
    more = F.transform("again", lambda n: F.struct(F.lit("E11").alias("code"), n.alias("field")))
    return joined.withColumn("errors", F.when(F.col("again").isNull(), F.col("errors")).otherwise(F.concat("errors", more))).drop("k", "at", "again")


def records(docs: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """A row for each record line: key, line, record (the contract's struct), errors (array of code and field). Uniqueness is by document; only records without another error claim a value."""
    return _parsed(docs, contract, key, False).select(key, "line", "record", "errors")


def diagnostics(docs: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """For each document: n, received, valid, invalid, missing, excess, truncated, its errors (header's, lines', count's), valid_lines and invalid_lines."""
    by = _parsed(docs, contract, key, True).groupBy(key).agg(
        F.first("n").alias("n"),
        F.first("total").alias("received"),
        F.first("header_line").alias("header_line"),
        F.first("header_errors").alias("header_errors"),
        F.count_if(F.col("line").isNotNull() & (F.size("errors") == 0)).alias("valid"),
        F.array_sort(F.collect_list(F.when(F.size("errors") > 0, F.struct("line", F.transform("errors", lambda e: e["code"]).alias("codes"))))).alias("bad"),
        F.array_sort(F.collect_list(F.when(F.size("errors") == 0, F.col("line")))).alias("valid_lines"),
        F.max_by(F.col("cut") & F.exists("errors", lambda e: e["code"].isin("E05", "E09")), "line").alias("cut"),
    )
    error = lambda line, code: F.struct(line.cast("int").alias("line"), code.alias("code"))
    head = F.transform("header_errors", lambda e: error(F.coalesce("header_line", F.lit(0)), e["code"]))
    body = F.flatten(F.transform("bad", lambda b: F.transform(b["codes"], lambda c: error(b["line"], c))))
    count = F.when(F.col("n") != F.col("received"), F.array(error(F.lit(0), F.lit("E04")))).otherwise(F.array().cast("array<struct<line:int,code:string>>"))
    missing = F.greatest(F.coalesce(F.col("n") - F.col("received"), F.lit(0)), F.lit(0))
    return by.select(
        key,
        "n",
        "received",
        "valid",
        (F.col("received") - F.col("valid")).alias("invalid"),
        missing.alias("missing"),
        F.greatest(F.coalesce(F.col("received") - F.col("n"), F.lit(0)), F.lit(0)).alias("excess"),
        ((missing > 0) | F.coalesce("cut", F.lit(False))).alias("truncated"),
        F.concat(head, body, count).alias("errors"),
        "valid_lines",
        F.transform("bad", lambda b: b["line"]).alias("invalid_lines"),
    )


def decode(docs: DataFrame, contract: Contract, strict: bool = True, key: str = "doc_id") -> DataFrame:
    """key, line and the contract's columns. Lenient: the records without errors. Strict: those of documents without any."""
    rows = _parsed(docs, contract, key, False)
    if strict:
        # judged with the rows' own errors: a filter by headers alone would be pushed below the steps that make them, and make them again for each use
        right = (F.size("header_errors") == 0) & F.coalesce(F.col("n") == F.col("total"), F.lit(False))
        rows = rows.withColumn("bad", F.max((F.size("errors") > 0) | ~right).over(Window.partitionBy(key))).where("NOT bad")
    return rows.where(F.size("errors") == 0).select(key, "line", "record.*")


def _encoded(f: Field, contract: Contract) -> Column:
    value = F.col(f"`{f.name}`")
    if f.type in ("list", "mlist"):
        marked = (lambda i: F.col(f"`{f.selection}`") == i) if f.type == "mlist" and f.marker in ("exactly_one", "at_most_one") else (lambda i: F.array_contains(f"`{f.selection}`", i.cast("int")))
        bare = f.item == "int" and contract.separator == ","  # digits need no escape
        text = lambda x, i: F.concat(S.scalar_text(x, f.item) if bare else L.escaped_element(S.scalar_text(x, f.item), contract.separator), F.when(marked(i), "*").otherwise("") if f.type == "mlist" else F.lit(""))
        return F.coalesce(F.array_join(F.transform(value, text), contract.separator), F.lit(""))
    if f.type == "tuple":
        return F.coalesce(F.when(value.isNotNull(), F.concat_ws(contract.separator, *(F.coalesce(L.escaped_element(S.scalar_text(value[p.name], p.type), contract.separator), F.lit("")) for p in f.parts))), F.lit(""))
    return F.coalesce(L.escaped_scalar(S.scalar_text(value, f.type)), F.lit(""))


def encode_records(df: DataFrame, contract: Contract, line: str = "wire") -> DataFrame:
    """df with its records' lines: core fields always, empty extensions at the end left out."""
    core = F.concat_ws("|", *(_encoded(f, contract) for f in contract.core))
    tail = F.lit("")
    for f in reversed(contract.extensions):
        cell = _encoded(f, contract)
        tail = F.when((cell == "") & (tail == ""), "").otherwise(F.concat(F.lit("|"), cell, tail))
    return df.withColumn(line, F.concat(core, tail))


def encode(df: DataFrame, contract: Contract, order: list[str], key: str = "doc_id", version: int = 1, **header: Column) -> DataFrame:
    """A document for each key: its text, the records by ``order``. header: values of header keys, the same for all records of a document; keys that the contract doesn't declare come last, as text."""
    rows = encode_records(df, contract)
    declared = {f.name for f in contract.header}
    given = [f for f in contract.header if f.name in header] + [Field(name) for name in header if name not in declared]
    heads = [F.first(header[f.name]).alias(f"__{f.name}") for f in given]
    lines_of = F.sort_array(F.collect_list(F.struct(*order, "wire")))  # by the natural order, without array_sort's function
    grouped = rows.groupBy(key).agg(lines_of.alias("__lines"), *heads)
    entries = [F.concat(F.lit(f"{contract.prefix}|n="), F.size("__lines").cast("string"))]
    if version != 1:
        entries.append(F.lit(f"v={version}"))
    entries += [F.when(F.col(f"__{f.name}").isNotNull(), F.concat(F.lit(f"{f.name}="), L.escaped_scalar(S.scalar_text(F.col(f"__{f.name}"), f.type)))) for f in given]
    text = F.concat(F.concat_ws("|", *entries), F.lit("\n"), F.array_join(F.transform("__lines", lambda x: x["wire"]), "\n"), F.lit("\n"))
    return grouped.select(key, text.alias("text"))


def verified(documents: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """Documents that don't read back without errors; a writer is right if this is empty."""
    return diagnostics(documents, contract, key).where(F.size("errors") > 0)

