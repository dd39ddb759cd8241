"""Contracts: what the fields of a record and of a header are. Invalid ones raise E20, invalid forks E21."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

SCALARS = ("str", "int", "float", "bool", "enum", "date", "decimal")
MARKERS = ("exactly_one", "at_least_one", "at_most_one", "any")
_SPARK = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "enum": T.StringType(), "date": T.StringType(), "decimal": T.StringType()}


class ContractError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    optional: bool = False
    unique: bool = False
    values: tuple[str, ...] = ()
    item: str = "str"
    low: float | str | None = None  # of a number, a date or a decimal; of a list, its least length
    high: float | str | None = None
    count_key: str | None = None
    marker: str = "exactly_one"
    selection: str = "selected"
    parts: tuple[Field, ...] = ()
    default: object = None
    description: str = ""

    @staticmethod
    def from_dict(d: dict, header: bool = False) -> Field:
        """A field of a contract file."""
        if "name" not in d or "type" not in d:
            raise ContractError("E20", "a field needs a name and a type")
        names = d.get("json", {})
        marker = d.get("marker", "exactly_one")
        return Field(
            d["name"],
            d["type"],
            bool(d.get("optional", False)),
            bool(d.get("unique", False)),
            tuple(d.get("item_values" if d["type"] in ("list", "mlist") else "values", ())),
            d.get("item", "str"),
            d.get("min"),
            d.get("max"),
            d.get("count_key"),
            marker,
            names.get("selected", "correct" if d["type"] == "mlist" and marker == "exactly_one" else "selected"),
            tuple(Field.from_dict(x) for x in d.get("items", ())),
            d.get("default"),
            d.get("desc", ""),
        )

    def to_dict(self) -> dict:
        lists = self.type in ("list", "mlist")
        d: dict = {"name": self.name, "type": self.type}
        d |= {k: True for k in ("optional", "unique") if getattr(self, k)}
        if self.values:
            d["item_values" if lists else "values"] = list(self.values)
        if lists:
            d["item"] = self.item
        if self.count_key:
            d["count_key"] = self.count_key
        d |= {k: v for k, v in (("min", self.low), ("max", self.high)) if v is not None}
        if self.type == "mlist":
            d |= {"marker": self.marker, "json": {"selected": self.selection}}
        if self.type == "tuple":
            d["items"] = [p.to_dict() for p in self.parts]
        return d | {k: v for k, v in (("desc", self.description), ("default", self.default)) if v not in (None, "")}

    def signature(self) -> str:
        """A short text of the field: name, type, bounds, marks, and ? where it is optional."""
        body = {"enum": "enum{" + "|".join(self.values) + "}", "tuple": "(" + ",".join(p.signature() for p in self.parts) + ")"}.get(self.type, self.type)
        if self.type in ("list", "mlist"):
            body += "<" + ("enum{" + "|".join(self.values) + "}" if self.item == "enum" else self.item) + ">"
        if self.low is not None or self.high is not None:
            body += f"[{'' if self.low is None else self.low}..{'' if self.high is None else self.high}]"
        if self.type == "mlist":
            body += {"exactly_one": "*1", "at_least_one": "*+", "at_most_one": "*?", "any": "*"}[self.marker]
        return f"{self.name}: {body}" + ("?" if self.optional else "") + ("!" if self.unique else "")

    def spark_type(self) -> T.DataType:
        if self.type in ("list", "mlist"):
            return T.ArrayType(_SPARK[self.item])
        if self.type == "tuple":
            return T.StructType([T.StructField(p.name, p.spark_type()) for p in self.parts])
        return _SPARK[self.type]

    def check(self) -> None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.name):
            raise ContractError("E20", f"bad name {self.name!r}")
        if self.type not in (*SCALARS, "list", "mlist", "tuple"):
            raise ContractError("E20", f"bad type {self.type!r}")
        if "enum" in (self.type, self.item) and not self.values:
            raise ContractError("E20", f"{self.name}: an enumeration needs values")
        if self.type in ("list", "mlist") and self.item not in SCALARS:
            raise ContractError("E20", f"{self.name}: bad item type")
        if self.type == "mlist" and self.marker not in MARKERS:
            raise ContractError("E20", f"{self.name}: bad marker rule")
        if self.type == "tuple" and (not self.parts or any(p.type not in SCALARS for p in self.parts)):
            raise ContractError("E20", f"{self.name}: a tuple needs scalar parts")
        if self.unique and self.type == "tuple":
            raise ContractError("E20", f"{self.name}: a tuple can't be unique")
        bounds = [self._bound(x) for x in (self.low, self.high) if x is not None]
        if len(bounds) == 2 and bounds[0] > bounds[1]:
            raise ContractError("E20", f"{self.name}: empty range")

    def _bound(self, x):
        """A bound in an order of its type; E20 if it isn't of that type."""
        try:
            if self.type == "date":
                return datetime.date.fromisoformat(str(x))
            if self.type == "decimal":
                return Decimal(str(x))
            if self.type in ("int", "float", "list", "mlist"):
                return float(x)
        except (ValueError, ArithmeticError):
            pass
        raise ContractError("E20", f"{self.name}: bad bound {x!r}")


@dataclass(frozen=True)
class Contract:
    prefix: str
    core: tuple[Field, ...]
    extensions: tuple[Field, ...] = ()
    header: tuple[Field, ...] = ()
    version: int = 1
    separator: str = ","
    records_key: str = "items"
    parent: str | None = None
    name: str = ""

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", self.prefix):
            raise ContractError("E20", f"bad prefix {self.prefix!r}")
        if not self.core:
            raise ContractError("E20", "no core field")
        if len(self.separator) != 1 or self.separator in '|\\*"n\n' or self.separator.isspace():
            raise ContractError("E20", "bad separator")
        names = [f.name for f in self.fields] + [f.selection for f in self.fields if f.type == "mlist"]
        if len(set(names)) < len(names):
            raise ContractError("E20", "a name is used twice")
        for f in (*self.fields, *self.header):
            f.check()
        if any(not f.optional for f in self.extensions):
            raise ContractError("E20", "extensions are optional")
        if any(f.type == "mlist" for f in self.header):
            raise ContractError("E20", "a header key can't be a marked list")

    @staticmethod
    def from_dict(d: dict) -> Contract:
        """The contract of a contract file; header keys are required where header.required names them."""
        if not isinstance(d, dict) or "prefix" not in d:
            raise ContractError("E20", "a contract needs a prefix")
        head = d.get("header", {})
        needed = set(head.get("required", ()))
        keys = {k: v if isinstance(v, dict) else {"type": v} for k, v in head.get("keys", {}).items() if k not in ("n", "v")}
        unknown = needed - set(keys) - {"n", "v"}
        if unknown:
            raise ContractError("E20", f"required header keys without a type: {', '.join(sorted(unknown))}")
        header = tuple(Field.from_dict({"name": k, **v, "optional": k not in needed}) for k, v in keys.items())
        core = tuple(Field.from_dict(f) for f in d.get("core", ()))
        extensions = tuple(Field.from_dict({**f, "optional": True}) for f in d.get("extensions", ()))
        return Contract(d["prefix"], core, extensions, header, int(d.get("version", 1)), d.get("list_separator", ","), d.get("records_key", "records"), d.get("parent"), d.get("name", ""))

    def to_dict(self) -> dict:
        keys = {f.name: {k: v for k, v in f.to_dict().items() if k not in ("name", "optional")} for f in self.header}
        header = {"required": sorted({"n", *(f.name for f in self.header if not f.optional)}), "keys": keys}
        extensions = [{k: v for k, v in f.to_dict().items() if k != "optional"} for f in self.extensions]
        return {"prefix": self.prefix, "version": self.version, "name": self.name, "parent": self.parent, "list_separator": self.separator, "records_key": self.records_key, "header": header, "core": [f.to_dict() for f in self.core], "extensions": extensions}

    def fingerprint(self) -> str:
        """Twelve hexadecimal digits of what the contract means, whatever it is called."""
        d = {k: v for k, v in self.to_dict().items() if k != "name"}
        return hashlib.sha256(json.dumps(d, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:12]

    @property
    def fields(self) -> tuple[Field, ...]:
        return self.core + self.extensions

    def schema(self) -> T.StructType:
        out = []
        for f in self.fields:
            out.append(T.StructField(f.name, f.spark_type()))
            if f.type == "mlist":
                one = f.marker in ("exactly_one", "at_most_one")
                out.append(T.StructField(f.selection, T.IntegerType() if one else T.ArrayType(T.IntegerType())))
        return T.StructType(out)


def check_fork(parent: Contract, child: Contract) -> None:
    """The invariants of a fork: another prefix, the parent's fields first, optional new ones, the parent's required header keys."""
    own = child.fields[: len(parent.fields)]
    if child.prefix == parent.prefix:
        raise ContractError("E21", "a fork needs a prefix of its own")
    if own != parent.fields or child.separator != parent.separator:
        raise ContractError("E21", "a fork starts with its parent's fields, unchanged")
    if any(not f.optional for f in child.fields[len(parent.fields) :]):
        raise ContractError("E21", "fields that a fork adds are optional")
    if {f.name for f in parent.header if not f.optional} - {f.name for f in child.header if not f.optional}:
        raise ContractError("E21", "a required header key of the parent is missing")


class Registry:
    """Contracts by prefix, with their lineage."""

    def __init__(self, contracts: tuple[Contract, ...] = ()):
        self.contracts: dict[str, Contract] = {}
        for c in contracts:
            if c.prefix in self.contracts:
                raise ContractError("E21", f"{c.prefix} is registered twice")
            if c.parent is not None:
                if c.parent not in self.contracts:
                    raise ContractError("E21", f"unknown parent {c.parent}")
                check_fork(self.contracts[c.parent], c)
            self.contracts[c.prefix] = c

    @staticmethod
    def read(folder: str) -> Registry:
        """The contracts of <folder>/<prefix>/contract.json, parents first; a folder that isn't named by its prefix is E21."""
        found: dict[str, Contract] = {}
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name, "contract.json")
            if os.path.isfile(path):
                with open(path, encoding="utf-8-sig") as f:
                    c = Contract.from_dict(json.load(f))
                if c.prefix != name:
                    raise ContractError("E21", f"the folder {name} holds the contract {c.prefix}")
                found[name] = c
        order: list[str] = []

        def add(prefix: str, below: tuple[str, ...]) -> None:
            if prefix in below:
                raise ContractError("E21", f"{prefix} is its own ancestor")
            if prefix in found and prefix not in order:
                if found[prefix].parent is not None:
                    add(found[prefix].parent, (*below, prefix))
                order.append(prefix)

        for prefix in found:
            add(prefix, ())
        return Registry(tuple(found[p] for p in order))

    def index(self) -> list[dict]:
        """A row for each contract: prefix, name, version, parent, number of fields, fingerprint."""
        return [{"prefix": c.prefix, "name": c.name, "version": c.version, "parent": c.parent, "fields": len(c.fields), "fingerprint": c.fingerprint()} for c in self.contracts.values()]

    def __getitem__(self, prefix: str) -> Contract:
        if prefix not in self.contracts:
            raise ContractError("E02", f"unknown prefix {prefix}")
        return self.contracts[prefix]

    def lineage(self, prefix: str) -> list[str]:
        out = [prefix]
        while (up := self[out[-1]].parent) is not None:
            out.append(up)
        return out
