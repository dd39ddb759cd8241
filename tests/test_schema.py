import json

import pytest

from lineform.contract import Contract, ContractError, Field, Registry
from lineform.schema import from_json_schema, to_json_schema

FULL = Contract(
    "sc",
    (Field("id", unique=True), Field("q", "int", low=0, high=9), Field("c", "enum", values=("a", "b")), Field("d", "date", low="2020-01-01"), Field("m", "decimal", high="9.5")),
    (Field("xs", "list", optional=True, item="int", low=1, high=3, count_key="k"), Field("ys", "mlist", optional=True, marker="any", selection="picked"), Field("p", "tuple", optional=True, parts=(Field("x", "int"), Field("y", "float", optional=True)))),
    header=(Field("k", "int"), Field("note", optional=True)),
    separator=";",
    name="a contract",
)


def test_round_trips():
    assert from_json_schema(json.loads(json.dumps(to_json_schema(FULL)))) == FULL
    assert Contract.from_dict(json.loads(json.dumps(FULL.to_dict()))) == FULL
    assert len(FULL.fingerprint()) == 12 and FULL.fingerprint() != Contract("sc", (Field("id"),)).fingerprint()
    assert [f.signature() for f in FULL.fields][1:3] == ["q: int[0..9]", "c: enum{a|b}"]


def test_record_schema_with_references():
    schema = {"$defs": {"n": {"type": "integer", "exclusiveMinimum": 0}}, "type": "object", "required": ["a", "b"], "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "c": {"allOf": [{"type": ["boolean", "null"]}], "x-odd": 1}}}
    warnings = []
    c = from_json_schema(schema, "r", warnings=warnings)
    assert c.core == (Field("a", "int", low=1), Field("b", optional=True)) and c.extensions == (Field("c", "bool", optional=True),)
    assert warnings == ["#/properties/c: not representable: x-odd"]
    for bad in ({**schema, "required": []}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "object"}}}, {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/zz"}}}, {"type": "string"}):
        with pytest.raises(ContractError) as e:
            from_json_schema(bad, "r")
        assert e.value.code == "E20"
    with pytest.raises(ContractError):
        from_json_schema(schema, "r", strict=True)


def test_registry_folder(tmp_path):
    base, child = Contract("base", (Field("a"),)), Contract("a1", (Field("a"),), (Field("z", optional=True),), parent="base")
    for c in (base, child):
        (tmp_path / c.prefix).mkdir()
        (tmp_path / c.prefix / "contract.json").write_text(json.dumps(c.to_dict()))
    found = Registry.read(str(tmp_path))
    assert list(found.contracts) == ["base", "a1"] and found.lineage("a1") == ["a1", "base"] and [r["fields"] for r in found.index()] == [1, 2]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "contract.json").write_text(json.dumps(base.to_dict()))
    with pytest.raises(ContractError) as e:
        Registry.read(str(tmp_path))
    assert e.value.code == "E21"


def test_bounds_and_uniqueness():
    for bad in (Field("d", "date", low="2020-13-01"), Field("m", "decimal", low="x"), Field("d", "date", low="2021-01-01", high="2020-01-01"), Field("s", low=1)):
        with pytest.raises(ContractError) as e:
            Contract("x", (bad,))
        assert e.value.code == "E20"
    Contract("x", (Field("l", "list", unique=True),))
