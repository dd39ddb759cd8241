"""The domain profile: JSON documents as positional lines under a contract that is inferred from samples.

JSON is handled as Spark variants. A schema is a tree of nodes (dictionaries): type (string, integer, number,
boolean, object, array or json), nullable, and the fields or items below. ``infer`` widens the kinds of all samples
level by level, with one aggregate of the paths a level. Expressions built from the tree turn values into cells and
back; documents never leave Spark.

A document's text is a header (prefix, v, n, h the contract's fingerprint, m the wrapper without its records, d
constant columns, e dictionaries) and a line for each record. A column whose cells are all equal over three rows or
more, and saves more bytes than its entry costs, is given once; a string column of 2 to 64 distinct cells over six
rows or more is given as codes in order of first appearance where that saves enough. Both are decided from
aggregates by document and column, so a document's rows are spread over tasks until its text is put together.

Fields of an object are in order of their names, as variants keep them. A fault is a code: D_TYPE, D_REQUIRED,
D_UNKNOWN, D_HEADER, D_PREFIX, D_CONTRACT, D_COUNT, D_ENVELOPE, D_ESCAPE, D_ARITY, D_ENUM, D_VALUE, D_REPAIR.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineform.functions.lexical import bound
from lineform.operators.staging import spread, staged

PROFILE = "rows/1"
#: The least rows and the bounds of what is factored out; fixed values of the format.
CONSTANT_ROWS, CODED_ROWS, MOST_CODES, LEAST_BYTES = 3, 6, 64, 6


class DomainError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Domain:
    """A contract: prefix, schema of a whole document, and the path to its records (None: the document is the record)."""

    prefix: str
    schema: dict = field(hash=False)
    record_path: tuple[str, ...] | None = ()

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", self.prefix):
            raise DomainError("D_PREFIX", f"bad prefix {self.prefix!r}")
        self.row  # noqa: B018 raises where the path leads nowhere

    @property
    def row(self) -> dict:
        """The schema of a record."""
        if self.record_path is None:
            return self.schema
        node = self.schema
        try:
            for name in self.record_path:
                node = next(f["schema"] for f in node["fields"] if f["name"] == name)
            return node["items"]
        except (KeyError, StopIteration):
            raise DomainError("D_PATH", "the record path has to lead to an array") from None

    @property
    def schema_id(self) -> str:
        semantic = {"profile": PROFILE, "prefix": self.prefix, "version": 1, "schema": self.schema, "record_path": None if self.record_path is None else list(self.record_path)}
        return hashlib.sha256(json.dumps(semantic, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:12]

    @property
    def columns(self) -> list[dict]:
        """The columns of a record: leaves of required objects, named by their pointers."""
        if not _spread(self.row):
            return [{"name": "$value", "path": [], "schema": self.row, "optional": False}]
        out = []

        def visit(node: dict, path: list[str]) -> None:
            for f in node["fields"]:
                at = [*path, f["name"]]
                if _spread(f["schema"]) and not f["optional"]:
                    visit(f["schema"], at)
                else:
                    out.append({**f, "name": pointer(at), "path": at})

        visit(self.row, [])
        return out


def pointer(path: list[str]) -> str:
    return "/".join(p.replace("~", "~0").replace("/", "~1") for p in path)


def _spread(node: dict) -> bool:
    return node["type"] == "object" and not node.get("nullable")


# ---- inference


def kind_of(v: Column) -> Column:
    """The JSON kind of a variant; null for none."""

    def named(t: Column) -> Column:
        whole = t.rlike(r"^DECIMAL\((19|[23]\d),0\)")
        return F.when(t == "VOID", "null").when((t == "BIGINT") | whole, "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")

    return bound(F.schema_of_variant(v), named)


def paths(samples: DataFrame, value: str = "v", most_depth: int = 64) -> list[tuple[tuple[str, ...], dict[str, int]]]:
    """(path, number of values by kind) of all values of the samples; [] in a path stands for an array's items. What the driver gets is a row for each path and kind."""
    level = samples.select(F.array().cast("array<string>").alias("path"), F.col(value).alias("v"))
    found: dict[tuple[str, ...], dict[str, int]] = {}
    for _ in range(most_depth):
        by = level.groupBy("path", kind_of(F.col("v")).alias("kind")).agg(F.count("*").alias("n")).collect()
        for r in by:
            found.setdefault(tuple(r.path), {})[r.kind] = r.n
        if not any(r.kind in ("object", "array") for r in by):
            return sorted(found.items())
        inner = level.where(kind_of(F.col("v")).isin("object", "array")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("k"), F.col("value").alias("w")))
        level = inner.select(F.concat("path", F.array(F.coalesce("k", F.lit("[]")))).alias("path"), F.col("w").alias("v"))
    raise DomainError("D_SAMPLES", f"values are nested more than {most_depth} levels deep")


def infer(samples: DataFrame, value: str = "v") -> dict:
    """The narrowest schema that all samples (variants) have."""
    found = dict(paths(samples, value))
    if not found:
        raise DomainError("D_SAMPLES", "no sample")

    def node(path: tuple[str, ...]) -> dict:
        kinds = dict(found[path])
        nulls = kinds.pop("null", 0)
        if not kinds:
            return {"type": "json"}
        if set(kinds) <= {"integer", "number"}:
            out = {"type": "number" if "number" in kinds else "integer"}
        elif len(kinds) > 1:
            out = {"type": "json"}
        else:
            (kind,) = kinds
            out = {"type": kind}
            below = [p for p in found if len(p) == len(path) + 1 and p[: len(path)] == path]
            if kind == "object":
                out["fields"] = [{"name": p[-1], "optional": sum(found[p].values()) < kinds["object"], "schema": node(p)} for p in sorted(below)]
            elif kind == "array":
                out["items"] = node(below[0]) if below else {"type": "json"}
        return out | ({"nullable": True} if nulls else {})

    return node(())


def infer_domain(samples: DataFrame, prefix: str, record_path: tuple[str, ...] | None | str = "choose", value: str = "v") -> Domain:
    """The contract of sample documents. The records are a root array, or the array of objects with the most rows that all samples have (then the shallower, then the later name)."""
    schema = infer(samples, value)
    if record_path != "choose":
        return Domain(prefix, schema, record_path)
    if schema["type"] == "array":
        return Domain(prefix, schema, ())
    arrays: list[tuple[str, ...]] = []

    def visit(node: dict, path: tuple[str, ...]) -> None:
        for f in node.get("fields", ()):
            at, kind = (*path, f["name"]), f["schema"]["type"]
            if kind == "array" and not f["optional"] and not f["schema"].get("nullable") and _spread(f["schema"]["items"]):
                arrays.append(at)
            elif kind == "object" and not f["optional"] and not f["schema"].get("nullable"):
                visit(f["schema"], at)

    if _spread(schema):
        visit(schema, ())
    if not arrays:
        return Domain(prefix, schema, None)
    sizes = samples.agg(*(F.sum(F.size(F.variant_get(value, _path(list(p)), "array<variant>"))).alias(str(i)) for i, p in enumerate(arrays))).first()
    return Domain(prefix, schema, max(zip(sizes, arrays, strict=True), key=lambda x: (x[0] or 0, -len(x[1]), x[1]))[1])


# ---- cells


def _path(path: list[str]) -> str:
    return "$" + "".join("[" + json.dumps(p, ensure_ascii=False) + "]" for p in path)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return bound(F.to_json(F.array(text)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _number(v: Column) -> Column:
    """A number's text; a fraction of zero stays visible."""
    text = F.to_json(v)
    return F.when(F.schema_of_variant(v).rlike(r"^DECIMAL\((\d|1[0-8]),0\)"), F.concat(text, F.lit(".0"))).otherwise(text)


def packed(v: Column, node: dict, skip: tuple[str, ...] | None = None) -> Column:
    """A value as positional JSON text: objects as arrays, {} for a member that is absent; generic JSON in one-element arrays. The array at path skip is left empty."""
    kind = node["type"]
    if skip == ():
        return F.lit("[]")
    if kind == "json":
        return F.when(F.is_variant_null(v), "null").otherwise(F.concat(F.lit("["), F.to_json(v), F.lit("]")))
    if kind == "object":
        parts = []
        for f in node["fields"]:
            below = skip[1:] if skip and skip[0] == f["name"] else None
            member = F.variant_get(v, _path([f["name"]]), "variant")
            parts.append(F.coalesce(bound(member, lambda x, f=f, below=below: F.when(x.isNotNull(), packed(x, f["schema"], below))), F.lit("{}")))
        text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    elif kind == "array":
        text = F.concat(F.lit("["), F.array_join(F.transform(F.variant_get(v, "$", "array<variant>"), lambda x: packed(x, node["items"])), ","), F.lit("]"))
    else:
        text = _number(v) if kind == "number" else F.to_json(v)
    return F.when(F.is_variant_null(v), "null").otherwise(text)


def fault(v: Column, node: dict) -> Column:
    """The first fault of a value: D_TYPE, D_REQUIRED or D_UNKNOWN; null if it has the schema."""
    kind = node["type"]
    none = F.lit(None).cast("string")
    if kind == "json":
        return none
    null = none if node.get("nullable") else F.lit("D_TYPE")
    if kind == "object":
        names = [f["name"] for f in node["fields"]]

        def members(m: Column) -> Column:
            inner = [F.when(F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, names)).cast("array<string>"))) > 0, "D_UNKNOWN")]
            for f in node["fields"]:
                inner.append(bound(F.variant_get(v, _path([f["name"]]), "variant"), lambda x, f=f: F.when(x.isNull(), None if f["optional"] else F.lit("D_REQUIRED")).otherwise(fault(x, f["schema"]))))
            return F.when(F.is_variant_null(v), null).when(m.isNull() & v.isNotNull(), "D_TYPE").otherwise(F.coalesce(*inner))

        return bound(F.try_variant_get(v, "$", "map<string,variant>"), members)  # a value's kind by its whole schema would walk all that is below
    if kind == "array":
        first = lambda items: F.get(F.filter(F.transform(items, lambda x: fault(x, node["items"])), lambda c: c.isNotNull()), 0)
        return bound(F.try_variant_get(v, "$", "array<variant>"), lambda items: F.when(F.is_variant_null(v), null).when(items.isNull() & v.isNotNull(), "D_TYPE").otherwise(first(items)))

    def judged(actual: Column) -> Column:
        right = actual.isin("integer", "number") if kind == "number" else actual == kind
        return F.when(actual == "null", null).when(~right, "D_TYPE")

    return bound(kind_of(v), judged)


def cell_of(v: Column, node: dict) -> Column:
    """A column's cell: ? for absent, ~ for null, a bare string unless it would be taken for something else, JSON otherwise."""
    text = packed(v, node)
    if node["type"] == "string":
        text = bound(F.try_variant_get(v, "$", "string"), lambda bare: F.when((bare == "") | bare.isin("?", "~") | bare.startswith('"'), packed(v, node)).otherwise(bare))
    return F.when(v.isNull(), "?").when(F.is_variant_null(v), "~").otherwise(text)


def escaped(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# ---- writing


def record_cells(docs: DataFrame, domain: Domain, key: str = "doc_id", value: str = "v") -> DataFrame:
    """key, pos, cells of every record of the documents (variants)."""
    if domain.record_path is None:
        rows = docs.select(key, F.lit(0).alias("pos"), F.col(value).alias("r"))
    else:
        rows = docs.select(key, F.posexplode(F.variant_get(value, _path(list(domain.record_path)), "array<variant>")).alias("pos", "r"))
    cells = [bound(F.variant_get("r", _path(c["path"]), "variant") if c["path"] else F.col("r"), lambda x, c=c: cell_of(x, c["schema"])) for c in domain.columns]
    return rows.select(key, "pos", F.array(*cells).alias("cells"))


def savings(cells: DataFrame, domain: Domain, key: str = "doc_id", shared: bool = True, dictionaries: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of key, pos, cells: the constant columns (key, idx, cell) and the dictionaries (key, idx, values in order of their codes)."""
    each = cells.select(key, "pos", F.posexplode("cells").alias("idx", "cell"))
    values = each.groupBy(key, "idx", "cell").agg(F.count("*").alias("k"), F.min("pos").alias("first"))
    sized = values.withColumns({"w": F.octet_length(escaped(F.col("cell"))), "rows": F.sum("k").over(Window.partitionBy(key, "idx")), "distinct": F.count("*").over(Window.partitionBy(key, "idx"))})
    entry = F.octet_length(escaped(F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(","), _quoted(F.col("cell")), F.lit("]"))))
    constant = sized.where((F.col("distinct") == 1) & (F.col("rows") >= CONSTANT_ROWS) & (F.col("rows") * (F.col("w") + 1) > entry + 2 + 4) & F.lit(shared)).select(key, "idx", "cell")
    texts = [i for i, c in enumerate(domain.columns) if c["schema"]["type"] == "string"]
    few = sized.where(F.lit(dictionaries) & F.col("idx").isin(texts) & (F.col("rows") >= CODED_ROWS) & F.col("distinct").between(2, MOST_CODES) & (3 * F.col("distinct") <= F.col("rows")))
    coded = few.withColumn("code", F.row_number().over(Window.partitionBy(key, "idx").orderBy("first")) - 1)
    by = coded.groupBy(key, "idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "cell"))), lambda x: x["cell"]).alias("values"),  # MOST_CODES at most
        F.sum(F.col("w") * F.col("k")).alias("before"),
        F.sum(F.length(F.col("code").cast("string")) * F.col("k")).alias("digits"),
        F.sum(F.length("cell")).alias("chars"),
    )
    overhead = F.octet_length(escaped(F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(","), F.to_json("values"), F.lit("]")))) + 4
    worth = by.where((F.col("chars") >= LEAST_BYTES * F.size("values")) & (F.col("before") - F.col("digits") - overhead > F.greatest(F.lit(32), F.floor(overhead / 3))))
    return constant, worth.select(key, "idx", "values")


def encode_lines(docs: DataFrame, domain: Domain, key: str = "doc_id", value: str = "v", shared: bool = True, dictionaries: bool = True) -> DataFrame:
    """key, pos, line: the header at pos -1 and a line for each record. Documents with a fault aren't written; ``faults`` finds them."""
    good = spread(docs, key).where(fault(F.col(value), domain.schema).isNull())
    cells = staged(record_cells(good, domain, key, value))
    constant, coded = savings(cells, domain, key, shared, dictionaries)
    d = constant.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "cell"))).alias("d"))
    e = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "values"))).alias("e"))
    plan = d.join(e, key, "full")

    def written(i: Column, cell: Column) -> Column:
        book = F.get(F.filter("e", lambda b: b["idx"] == i), 0)["values"]
        return escaped(F.coalesce((F.array_position(book, cell) - 1).cast("string"), cell))

    kept = F.filter(F.transform("cells", lambda c, i: F.when(~F.coalesce(F.exists("d", lambda x: x["idx"] == i), F.lit(False)), written(i, c))), lambda c: c.isNotNull())
    lines = cells.join(plan, key, "left").select(key, "pos", bound(kept, lambda x: F.when(F.size(x) == 0, "-").otherwise(F.array_join(x, "|"))).alias("line"))
    if domain.record_path is None:
        n = F.lit(1)
    else:
        n = F.size(F.variant_get(value, _path(list(domain.record_path)), "array<variant>"))
    wrapper = F.concat(F.lit("m="), packed(F.col(value), domain.schema, tuple(domain.record_path))) if domain.record_path else F.lit(None).cast("string")
    pairs = lambda c, name, text: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}=["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit(","), text(x), F.lit("]"))), ","), F.lit("]")))
    head = F.concat_ws("|", F.lit(domain.prefix), F.lit("v=1"), F.concat(F.lit("n="), n.cast("string")), F.lit("h=" + domain.schema_id), escaped(wrapper), escaped(pairs("d", "d", lambda x: _quoted(x["cell"]))), escaped(pairs("e", "e", lambda x: F.to_json(x["values"]))))
    return lines.unionByName(good.join(plan, key, "left").select(key, F.lit(-1).alias("pos"), head.alias("line")))


def encode(docs: DataFrame, domain: Domain, key: str = "doc_id", value: str = "v", shared: bool = True, dictionaries: bool = True) -> DataFrame:
    """key and text of every document without a fault."""
    by = encode_lines(docs, domain, key, value, shared, dictionaries).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return by.select(key, F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def faults(docs: DataFrame, domain: Domain, key: str = "doc_id", value: str = "v") -> DataFrame:
    """key and code of the documents that don't have the contract's schema."""
    return docs.select(key, fault(F.col(value), domain.schema).alias("code")).where("code IS NOT NULL")


# ---- reading


def _cells(line: Column) -> Column:
    r"""struct(cells, ok) of a line; ok: backslashes escape only \ | n and r."""
    slash, pipe = "", ""
    ok = ~line.contains("\\") | line.rlike(r"\A(?:[^\\]++|\\[\\|nr])*+\z")
    marked = F.replace(F.replace(line, F.lit("\\\\"), F.lit(slash)), F.lit("\\|"), F.lit(pipe))
    opened = lambda x: F.translate(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), slash + pipe, "\\|")
    simple = F.split(line, r"\|", -1)
    return F.struct(F.when(line.contains("\\"), F.transform(F.split(marked, r"\|", -1), opened)).otherwise(simple).alias("cells"), ok.alias("ok"))


def unpacked(v: Column, node: dict) -> tuple[Column, Column]:
    """(JSON text, fault) of a positional variant."""
    kind, null = node["type"], F.is_variant_null(v)
    none = F.lit(None).cast("string")
    if kind == "json":
        one = F.variant_get(v, "$[0]", "variant")
        whole = (kind_of(v) == "array") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 1)
        return F.when(null, "null").otherwise(F.to_json(one)), F.when(null | whole, none).otherwise("D_TYPE")
    bad_null = none if node.get("nullable") else F.lit("D_TYPE")
    if kind == "object":
        items = F.try_variant_get(v, "$", "array<variant>")
        texts, codes = [], []
        for i, f in enumerate(node["fields"]):
            item = F.get(items, i)
            absent = F.to_json(item) == "{}"
            text, code = unpacked(item, f["schema"])
            texts.append(F.when(~absent, F.concat(F.lit(json.dumps(f["name"], ensure_ascii=False) + ":"), text)))
            codes.append(F.when(absent, none if f["optional"] else F.lit("D_REQUIRED")).otherwise(code))
        arity = F.when((kind_of(v) != "array") | (F.size(items) != len(texts)), "D_ARITY")
        return F.when(null, "null").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}"))), F.when(null, bad_null).otherwise(F.coalesce(arity, *codes))
    if kind == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        each = lambda k: F.transform(items, lambda x: unpacked(x, node["items"])[k])
        return F.when(null, "null").otherwise(F.concat(F.lit("["), F.array_join(each(0), ","), F.lit("]"))), F.when(null, bad_null).when(kind_of(v) != "array", "D_TYPE").otherwise(F.get(F.filter(each(1), lambda c: c.isNotNull()), 0))
    right = bound(kind_of(v), lambda k: k.isin("integer", "number")) if kind == "number" else kind_of(v) == kind
    return F.when(null, "null").otherwise(_number(v) if kind == "number" else F.to_json(v)), F.when(null, bad_null).when(~right, "D_TYPE")


def value_of(cell: Column, column: dict) -> Column:
    """struct(text, code) of a cell: JSON text, null for an absent member."""
    node = column["schema"]
    absent = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None if column["optional"] else "D_REQUIRED").cast("string").alias("code"))
    null = F.struct(F.lit("null").alias("text"), F.lit(None if node.get("nullable") or node["type"] == "json" else "D_TYPE").cast("string").alias("code"))

    def parsed(v: Column) -> Column:
        text, code = unpacked(v, node)
        return F.struct(text.alias("text"), F.when(v.isNull(), "D_VALUE").otherwise(code).alias("code"))

    read = bound(F.try_parse_json(cell), parsed)
    if node["type"] == "string":
        read = F.when(cell.startswith('"'), read).otherwise(F.struct(_quoted(cell).alias("text"), F.lit(None).cast("string").alias("code")))
    return F.when(cell == "?", absent).when(cell == "~", null).otherwise(read)


def read_lines(docs: DataFrame, domain: Domain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each record line: key, line (2 for the first), json, code; and one row with line 1 and json null for each document, whose code is the header's or the count's fault."""
    columns = domain.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.regexp_replace(whole, r"\n\z", ""), "\n", -1)
    top = spread(docs, key).select(key, whole.alias("t"), lines.alias("ls")).withColumn("h", _cells(F.get("ls", 0)))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v"), x.contains("=").alias("whole"))
    top = top.withColumn("es", F.transform(F.slice("h.cells", 2, F.greatest(F.size("h.cells") - 1, F.lit(0))), entry))
    value = lambda k: F.get(F.filter("es", lambda e: e["k"] == k), 0)["v"]
    pairs = lambda k, t: F.from_json(F.regexp_replace(value(k), r"\[(\d+),", r'["$1",') if t == "string" else value(k), f"array<array<{t}>>")
    top = top.withColumns({"n": value("n"), "d": pairs("d", "string"), "ev": F.try_variant_get(F.try_parse_json(value("e")), "$", "array<array<variant>>")})
    top = top.withColumn("e", F.transform("ev", lambda p: F.struct(F.try_variant_get(F.get(p, 0), "$", "int").alias("idx"), F.try_variant_get(F.get(p, 1), "$", "array<string>").alias("values"))))
    keys = F.transform("es", lambda e: e["k"])
    texts = [i for i, c in enumerate(columns) if c["schema"]["type"] == "string"]
    d_ok = F.coalesce(F.forall("d", lambda p: (F.size(p) == 2) & p[0].cast("int").between(0, len(columns) - 1)) & (F.size(F.array_distinct(F.transform("d", lambda p: p[0]))) == F.size("d")), F.lit(False))
    e_ok = F.coalesce(F.forall("e", lambda p: p["idx"].isin(texts) & (F.size(p["values"]) > 0) & (F.size(F.array_distinct(p["values"])) == F.size(p["values"]))) & (F.size(F.array_distinct(F.transform("e", lambda p: p["idx"]))) == F.size("e")), F.lit(False))
    has_m = F.array_contains(keys, "m")
    head = (
        F.when(F.col("t").contains("\r") | F.col("t").startswith("﻿"), "D_ENVELOPE")
        .when(F.get("ls", 0) == "", "D_HEADER")
        .when(~F.col("h.ok"), "D_ESCAPE")
        .when(F.get("h.cells", 0) != domain.prefix, "D_PREFIX")
        .when(F.exists("es", lambda e: ~e["whole"] | ~e["k"].isin("v", "n", "h", "m", "d", "e")) | (F.size(F.array_distinct(keys)) < F.size(keys)), "D_HEADER")
        .when(~F.coalesce((value("v") == "1") & (value("h") == domain.schema_id), F.lit(False)), "D_CONTRACT")
        .when(~F.coalesce(F.col("n").rlike(r"\A(0|[1-9][0-9]*)\z"), F.lit(False)), "D_COUNT")
        .when((F.array_contains(keys, "d") & ~d_ok) | (F.array_contains(keys, "e") & ~e_ok), "D_HEADER")
    )
    wrapper = F.when(has_m != F.lit(bool(domain.record_path)), "D_HEADER")
    total = F.size("ls") - 1
    count = F.when(F.col("n").cast("long") != total, "D_COUNT").when(F.lit(domain.record_path is None) & (total != 1), "D_COUNT")
    top = top.withColumn("head", head).withColumn("code", F.coalesce("head", count, wrapper))
    # the header's own row comes at pos 0, so that a document's text is read once
    top = top.withColumn("m", value("m"))
    rows = top.select(key, "d", "e", "m", F.col("code").alias("head_code"), F.posexplode(F.when(F.col("head").isNull(), F.col("ls")).otherwise(F.slice("ls", 1, 1))).alias("pos", "l"))
    shared = F.map_from_entries(F.transform(F.coalesce("d", F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].cast("int"), p[1])))
    rows = rows.withColumns({"shared": shared, "c": _cells(F.col("l"))})
    expected = F.lit(len(columns)) - F.size("shared")
    own = F.when((expected == 0) & (F.col("l") == "-"), F.array().cast("array<string>")).otherwise(F.col("c.cells"))
    rows = rows.withColumn("own", own).withColumn("bad", F.when(F.col("pos") == 0, "").when(~F.col("c.ok"), "D_ESCAPE").when(F.size("own") != expected, "D_ARITY"))
    values = {}
    for i, c in enumerate(columns):
        before = F.size(F.filter(F.map_keys("shared"), lambda k: k < i))
        raw = F.coalesce(F.col("shared")[F.lit(i)], F.get("own", F.lit(i) - before))
        if c["schema"]["type"] == "string":
            book = F.get(F.filter("e", lambda p: p["idx"] == i), 0)["values"]
            there = book.isNotNull()
            number = F.when(raw.rlike(r"\A(0|[1-9][0-9]*)\z"), raw.cast("int"))
            plain = F.get(book, number)
            enum = F.struct(F.lit(None).cast("string").alias("text"), F.lit("D_ENUM").alias("code"))
            cell = F.when(there, plain).otherwise(raw)
            values[f"c{i}"] = F.when(F.col("bad").isNull(), F.when(there & plain.isNull(), enum).otherwise(bound(cell, lambda x, c=c: value_of(x, c))))
        else:
            values[f"c{i}"] = F.when(F.col("bad").isNull(), bound(raw, lambda x, c=c: value_of(x, c)))
    rows = rows.withColumns(values)
    code = F.coalesce("bad", *(F.col(f"c{i}.code") for i in range(len(columns))))
    text_of = _assembled(domain, columns)
    body = F.col("pos") > 0
    return rows.select(key, (F.col("pos") + 1).alias("line"), F.when(body & code.isNull(), text_of).alias("json"), F.when(body, code).otherwise(F.col("head_code")).alias("code"), F.when(~body, F.col("m")).alias("wrapper"))


def _assembled(domain: Domain, columns: list[dict]) -> Column:
    """The JSON text of a record from its columns c0, c1, ..."""
    at = {tuple(c["path"]): F.col(f"c{i}.text") for i, c in enumerate(columns)}
    if not _spread(domain.row):
        return at[()]

    def build(node: dict, path: tuple[str, ...]) -> Column:
        parts = []
        for f in node["fields"]:
            own = (*path, f["name"])
            text = at[own] if own in at else build(f["schema"], own)
            parts.append(F.when(text.isNotNull(), F.concat(F.lit(json.dumps(f["name"], ensure_ascii=False) + ":"), text)))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")

    return build(domain.row, ())


def decode_records(docs: DataFrame, domain: Domain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, json of the records of documents without any fault."""
    rows = read_lines(docs, domain, key, text).withColumn("faulty", F.max(F.col("code").isNotNull()).over(Window.partitionBy(key)))
    return rows.where("NOT faulty AND line > 1").select(key, "line", "json")


def diagnose(docs: DataFrame, domain: Domain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ok, errors (line, code), valid_lines, invalid_lines of every document; lines are judged alone where the header is right."""
    rows = read_lines(docs, domain, key, text)
    by = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("line", "code")))).alias("errors"),
        F.array_sort(F.collect_list(F.when((F.col("line") > 1) & F.col("code").isNull(), F.col("line")))).alias("valid_lines"),
        F.array_sort(F.collect_list(F.when((F.col("line") > 1) & F.col("code").isNotNull(), F.col("line")))).alias("invalid_lines"),
    )
    return by.select(key, (F.size("errors") == 0).alias("ok"), "errors", "valid_lines", "invalid_lines")


# ---- repair of transport


def transport_repaired(text: Column) -> Column:
    """A text without byte order mark, CRLF, a code fence around it (closed or left open) and blank lines at its end; facts are never guessed."""
    t = F.replace(F.regexp_replace(text, "^\\x{feff}", ""), F.lit("\r\n"), F.lit("\n"))
    stripped = F.btrim(t, F.lit("\n"))
    opening = r"\A```(?:mini|text)?[ \t]*\n"
    closed = stripped.rlike(opening + r"[\s\S]*\n```\z")
    opened = stripped.rlike(opening) & ~F.regexp_replace(stripped, r"\A```(?:mini|text)?[ \t]*(?=\n)", "").contains("\n```")
    inner = F.regexp_replace(stripped, opening, "")
    bare = F.when(closed, F.regexp_replace(inner, r"\n```\z", "")).when(opened, inner).otherwise(t)
    return F.regexp_replace(bare, r"\n{2,}\z", "\n")


def apply_replacements(docs: DataFrame, replacements: DataFrame, domain: Domain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key, text with lines replaced (replacements: key, line, new), and code: D_REPAIR where a line wasn't invalid, is named twice or the new one isn't one line; else what reading the result finds first."""
    bad = read_lines(docs, domain, key, text).where("line > 1 AND code IS NOT NULL").select(key, "line", F.lit(True).alias("allowed"))
    asked = replacements.select(key, F.col("line").cast("int").alias("line"), F.col("new").cast("string").alias("new"))
    right = F.coalesce("allowed", F.lit(False)) & F.col("new").isNotNull() & ~F.col("new").rlike("[\\n\\r]")
    by = asked.join(bad, [key, "line"], "left").groupBy(key).agg(F.collect_list(F.struct("line", "new")).alias("changes"), F.bool_and(right).alias("right"), F.count_distinct("line").alias("lines"))
    joined = docs.select(key, text).join(by, key, "left")
    wrong = F.col("changes").isNull() | ~F.col("right") | (F.col("lines") < F.size("changes"))
    replaced = F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.get(F.filter("changes", lambda c: c["line"] == i + 1), 0)["new"], x)), "\n")
    done = joined.select(key, F.when(wrong, F.col(text)).otherwise(replaced).alias("text"), wrong.alias("wrong"))
    found = read_lines(done.where("NOT wrong"), domain, key).where("code IS NOT NULL").groupBy(key).agg(F.min_by("code", "line").alias("found"))
    return done.join(found, key, "left").select(key, "text", F.when(F.col("wrong"), "D_REPAIR").otherwise(F.col("found")).alias("code"))


def json_schema(node: dict) -> dict:
    """A schema node as JSON Schema."""
    if node["type"] == "json":
        return {}
    out: dict = {"type": [node["type"], "null"] if node.get("nullable") else node["type"]}
    if node["type"] == "object":
        out |= {"properties": {f["name"]: json_schema(f["schema"]) for f in node["fields"]}, "required": [f["name"] for f in node["fields"] if not f["optional"]], "additionalProperties": False}
    elif node["type"] == "array":
        out["items"] = json_schema(node["items"])
    return out
