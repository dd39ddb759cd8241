"""JSON Schema of contracts, and contracts of JSON Schemas.

A record schema is an object whose properties are a record's fields; a document schema is an object with one array
of objects, the records, beside header keys. References within the schema, one-element allOf, and null as one of two
types are resolved. What a contract can't say (other keywords) is listed in ``warnings``, or is E20 if ``strict``.
"""

from __future__ import annotations

from lineform.contract import Contract, ContractError, Field

#: Key of what JSON Schema has no word for.
EXTRA = "x-lineform"
_PLAIN = {"string": "str", "integer": "int", "number": "float", "boolean": "bool"}
_KNOWN = {"type", "properties", "required", "items", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "prefixItems", "format", "pattern", "title", "description", "default", "anyOf", "oneOf", "allOf", "$ref", "$defs", "definitions", "$schema", "$id", "additionalProperties", "uniqueItems", "examples", EXTRA}
_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"


def _bad(path: str, why: str) -> ContractError:
    return ContractError("E20", f"{path}: {why}")


class _Reader:
    def __init__(self, root: dict, strict: bool, warnings: list[str]):
        self.root, self.strict, self.warnings = root, strict, warnings

    def resolved(self, node, path: str, seen: tuple[str, ...] = ()) -> tuple[dict, bool]:
        """The node without references and null, and whether it may be null."""
        if not isinstance(node, dict):
            raise _bad(path, "a schema has to be an object")
        if "$ref" in node:
            ref = node["$ref"]
            if not ref.startswith("#/") or ref in seen:
                raise _bad(path, f"the reference {ref} can't be resolved")
            at = self.root
            for part in ref[2:].split("/"):
                at = at.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
            if at is None:
                raise _bad(path, f"the reference {ref} leads nowhere")
            node = {**at, **{k: v for k, v in node.items() if k != "$ref"}}
            return self.resolved(node, path, (*seen, ref))
        if "allOf" in node:
            if len(node["allOf"]) != 1:
                raise _bad(path, "allOf of several schemas")
            return self.resolved({**node["allOf"][0], **{k: v for k, v in node.items() if k != "allOf"}}, path, seen)
        nullable = False
        for word in ("anyOf", "oneOf"):
            if word in node:
                others = [x for x in node[word] if x.get("type") != "null"]
                if len(others) != 1 or len(node[word]) > 2:
                    raise _bad(path, f"{word} of several types")
                inner, deeper = self.resolved({**others[0], **{k: v for k, v in node.items() if k != word}}, path, seen)
                return inner, deeper or len(node[word]) == 2
        node = dict(node)
        if isinstance(node.get("type"), list):
            kinds = [k for k in node["type"] if k != "null"]
            nullable = len(kinds) < len(node["type"])
            if len(kinds) != 1:
                raise _bad(path, "several types")
            node["type"] = kinds[0]
        if None in node.get("enum", ()):
            nullable, node["enum"] = True, [x for x in node["enum"] if x is not None]
        odd = sorted(set(node) - _KNOWN)
        if odd:
            if self.strict:
                raise _bad(path, f"not representable: {', '.join(odd)}")
            text = f"{path}: not representable: {', '.join(odd)}"
            if text not in self.warnings:
                self.warnings.append(text)
        return node, nullable

    def scalar(self, name: str, node: dict, path: str, **more) -> Field:
        extra = node.get(EXTRA, {})
        values = node.get("enum") or ([node["const"]] if "const" in node else None)
        if values is not None:
            if not all(isinstance(v, str) for v in values):
                raise _bad(path, "only texts can be enumerated")
            return Field(name, "enum", values=tuple(values), **more)
        kind = _PLAIN.get(node.get("type"))
        if kind is None:
            raise _bad(path, f"no scalar type: {node.get('type')}")
        low, high = node.get("minimum"), node.get("maximum")
        if kind == "int":
            if "exclusiveMinimum" in node:
                low = node["exclusiveMinimum"] + 1
            if "exclusiveMaximum" in node:
                high = node["exclusiveMaximum"] - 1
        elif "exclusiveMinimum" in node or "exclusiveMaximum" in node:
            raise _bad(path, "an open bound of a fraction isn't representable")
        if kind == "str" and node.get("format") == "date":
            kind = "date"
        elif kind == "str" and (extra.get("type") == "decimal" or node.get("pattern") == _DECIMAL):
            kind = "decimal"
        if kind in ("date", "decimal"):
            low, high = extra.get("min"), extra.get("max")
        return Field(name, kind, low=low if kind != "bool" else None, high=high if kind != "bool" else None, **more)

    def field(self, name: str, raw, needed: bool, path: str) -> Field:
        node, nullable = self.resolved(raw, path)
        extra = node.get(EXTRA, {})
        more = {"optional": nullable or not needed, "unique": bool(extra.get("unique")), "default": node.get("default"), "description": node.get("description", "")}
        if node.get("type") == "array" and "prefixItems" not in node:
            item, item_null = self.resolved(node.get("items", {}), f"{path}/items")
            if item_null:
                raise _bad(path, "items can't be null")
            one = self.scalar(name, item, f"{path}/items")
            return Field(name, "mlist" if "marker" in extra else "list", item=one.type, values=one.values, low=node.get("minItems"), high=node.get("maxItems"), count_key=extra.get("count_key"), marker=extra.get("marker", "exactly_one"), selection=extra.get("selected", "selected"), **more)
        if node.get("type") == "object":
            parts = []
            for k, v in node.get("properties", {}).items():
                part, part_null = self.resolved(v, f"{path}/properties/{k}")
                parts.append(self.scalar(k, part, f"{path}/properties/{k}", optional=part_null or k not in node.get("required", ())))
            if not parts:
                raise _bad(path, "an object without properties")
            return Field(name, "tuple", parts=tuple(parts), **more)
        return self.scalar(name, node, path, **more)


def from_json_schema(schema: dict, prefix: str | None = None, records_key: str | None = None, strict: bool = False, warnings: list[str] | None = None) -> Contract:
    """The contract of a record schema or a document schema; E20 where there is none."""
    read = _Reader(schema, strict, warnings if warnings is not None else [])
    root, _ = read.resolved(schema, "#")
    props = root.get("properties")
    if not isinstance(props, dict):
        raise _bad("#", "not an object with properties")
    extra = root.get(EXTRA, {})

    def holds_records(raw, path: str) -> bool:
        node, _ = read.resolved(raw, path)
        return node.get("type") == "array" and isinstance(node.get("items"), dict) and read.resolved(node["items"], f"{path}/items")[0].get("type") == "object"

    arrays = [k for k, v in props.items() if holds_records(v, f"#/properties/{k}")]
    if records_key is not None and records_key not in arrays:
        raise _bad("#", f"{records_key} isn't an array of objects")
    key = records_key or (extra.get("records_key") if extra.get("records_key") in arrays else None)
    if key is None and arrays and set(props) - set(arrays) <= {"prefix", "header"}:
        if len(arrays) > 1:
            raise _bad("#", "several arrays of records")
        key = arrays[0]
    header: list[Field] = []
    record, path = root, "#"
    if key is not None:
        record, path = read.resolved(read.resolved(props[key], "#")[0]["items"], f"#/properties/{key}/items")[0], f"#/properties/{key}/items"
        for k, raw in props.items():
            node, _ = read.resolved(raw, f"#/properties/{k}")
            if k == "prefix" and ("const" in node or len(node.get("enum", ())) == 1):
                prefix = prefix or extra.get("prefix") or node.get("const") or node["enum"][0]
            elif k == "header" and node.get("type") == "object":
                header += [read.field(h, v, h in node.get("required", ()), f"#/properties/header/properties/{h}") for h, v in node.get("properties", {}).items() if h not in ("n", "v")]
            elif k not in arrays:
                header.append(read.field(k, raw, k in root.get("required", ()), f"#/properties/{k}"))
    fields_of = record.get("properties")
    if not isinstance(fields_of, dict):
        raise _bad(path, "records have to be objects with properties")
    chosen = {f.get("selected") for f in (p.get(EXTRA, {}) for p in fields_of.values() if isinstance(p, dict)) if "marker" in f}
    needed = set(record.get("required", ()))
    fields = {k: read.field(k, v, k in needed, f"{path}/properties/{k}") for k, v in fields_of.items() if k not in chosen}
    prefix = prefix or extra.get("prefix")
    core = tuple(f for k, f in fields.items() if k in needed)
    if not prefix or not core:
        raise _bad("#", "a prefix and a required property are needed")
    return Contract(prefix, core, tuple(f for k, f in fields.items() if k not in needed), tuple(header), int(extra.get("version", 1)), extra.get("list_separator", ","), key or extra.get("records_key", "records"), extra.get("parent"), root.get("title", ""))


def _scalar_schema(kind: str, values: tuple[str, ...], low, high) -> dict:
    bounds = {k: v for k, v in (("minimum", low), ("maximum", high)) if v is not None}
    if kind == "enum":
        return {"type": "string", "enum": list(values)}
    if kind in ("date", "decimal"):
        own = {k: v for k, v in (("min", low), ("max", high)) if v is not None}
        return ({"type": "string", "format": "date"} if kind == "date" else {"type": "string", "pattern": _DECIMAL}) | ({EXTRA: own} if own else {})
    return {"type": {v: k for k, v in _PLAIN.items()}[kind]} | (bounds if kind in ("int", "float") else {})


def _nullable(node: dict) -> dict:
    node = {**node, "type": [node["type"], "null"]}
    return node | ({"enum": [*node["enum"], None]} if "enum" in node else {})


def _field_schema(f: Field) -> dict[str, dict]:
    extra: dict = {"unique": True} if f.unique else {}
    more: dict[str, dict] = {}
    if f.type in ("list", "mlist"):
        node: dict = {"type": "array", "items": _scalar_schema(f.item, f.values, None, None)} | {k: int(v) for k, v in (("minItems", f.low), ("maxItems", f.high)) if v is not None}
        if f.count_key:
            extra["count_key"] = f.count_key
        if f.type == "mlist":
            extra |= {"marker": f.marker, "selected": f.selection}
            one = f.marker in ("exactly_one", "at_most_one")
            index = {"type": "integer", "minimum": 0} if one else {"type": "array", "items": {"type": "integer", "minimum": 0}}
            more[f.selection] = _nullable(index) if f.optional or f.marker == "at_most_one" else index
    elif f.type == "tuple":
        parts = {p.name: _nullable(_scalar_schema(p.type, p.values, p.low, p.high)) if p.optional else _scalar_schema(p.type, p.values, p.low, p.high) for p in f.parts}
        node = {"type": "object", "properties": parts, "required": list(parts), "additionalProperties": False}
    else:
        node = _scalar_schema(f.type, f.values, f.low, f.high)
        extra = {**node.pop(EXTRA, {}), **extra}
    node = _nullable(node) if f.optional else node
    node |= {k: v for k, v in (("description", f.description), ("default", f.default)) if v not in ("", None)}
    return {f.name: node | ({EXTRA: extra} if extra else {}), **more}


def to_json_schema(contract: Contract, record_only: bool = False) -> dict:
    """The JSON Schema of a contract's documents, or of its records."""
    props: dict = {}
    for f in contract.fields:
        props |= _field_schema(f)
    record = {"type": "object", "properties": props, "required": [n for f in contract.core for n in _field_schema(f)], "additionalProperties": False}
    extra = {"prefix": contract.prefix, "version": contract.version, "list_separator": contract.separator, "records_key": contract.records_key} | ({"parent": contract.parent} if contract.parent else {})
    top = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": contract.name, EXTRA: extra}
    if record_only:
        return {**top, **record}
    keys: dict = {"n": {"type": "integer", "minimum": 0}}
    for f in contract.header:
        keys |= _field_schema(f)
    header = {"type": "object", "properties": keys, "required": ["n", *(f.name for f in contract.header if not f.optional)]}
    return {**top, "type": "object", "properties": {"prefix": {"const": contract.prefix}, "header": header, contract.records_key: {"type": "array", "items": record}}, "required": ["prefix", "header", contract.records_key], "additionalProperties": False}
