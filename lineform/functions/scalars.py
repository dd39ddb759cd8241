"""Typed values of texts, and texts of typed values, as column expressions. A decoded value is a struct (value, code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineform.contract import Field

INT, FLOAT, DECIMAL, DATE = r"\A-?[0-9]+\z", r"\A-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z", r"\A-?[0-9]+(\.[0-9]+)?\z", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def normal_decimal(text: Column) -> Column:
    """Without leading zeros, and without the sign of a zero."""
    bare = F.regexp_replace(text, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(bare.rlike(r"^-0(\.0*)?$"), F.substring(bare, 2, 10**6)).otherwise(bare)


def _decimal_key(text: Column) -> Column:
    """A struct that orders decimals of any length: sign, digits of the integer part, integer part, fraction; for negative ones by magnitude."""
    bare = F.regexp_replace(text, "^-", "")
    whole = F.regexp_replace(F.substring_index(bare, ".", 1), "^0+(?=[0-9])", "")
    part = F.regexp_replace(F.when(bare.contains("."), F.substring_index(bare, ".", -1)).otherwise(""), "0+$", "")
    return F.struct(F.length(whole).alias("digits"), whole.alias("whole"), part.alias("part"))


def decimal_less(a: Column, b: Column) -> Column:
    low_a, low_b = a.startswith("-"), b.startswith("-")
    return F.when(low_a & ~low_b, True).when(~low_a & low_b, False).when(low_a, _decimal_key(b) < _decimal_key(a)).otherwise(_decimal_key(a) < _decimal_key(b))


def parsed(text: Column, f: Field, kind: str) -> tuple[Column, Column]:
    """The typed value of a restored text, and whether it has the type."""
    if kind == "int":
        value = text.try_cast("bigint")
        return F.when(text.rlike(INT), value), text.rlike(INT) & value.isNotNull()
    if kind == "float":
        value = text.try_cast("double")
        ok = text.rlike(FLOAT) & value.isNotNull() & (F.abs(value) != float("inf"))
        return F.when(ok, value), ok
    if kind == "bool":
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False), text.isin("true", "false", "1", "0")
    if kind == "enum":
        return F.when(text.isin(*f.values), text), text.isin(*f.values)
    if kind == "date":
        ok = text.rlike(DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull() & ~text.startswith("0000")
        return F.when(ok, text), ok
    if kind == "decimal":
        return F.when(text.rlike(DECIMAL), normal_decimal(text)), text.rlike(DECIMAL)
    return text, F.lit(True)


def in_range(value: Column, f: Field) -> Column:
    ok = F.lit(True)
    if f.type == "decimal":
        if f.low is not None:
            ok = ok & ~decimal_less(value, F.lit(str(f.low)))
        if f.high is not None:
            ok = ok & ~decimal_less(F.lit(str(f.high)), value)
        return ok
    if f.low is not None:
        ok = ok & (value >= f.low)
    if f.high is not None:
        ok = ok & (value <= f.high)
    return ok


def number_text(x: Column) -> Column:
    """The shortest text of a double: integral values without a fraction, no exponent."""
    plain = F.format_string("%.15f", x)
    short = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    whole = F.when(F.abs(x) < 1e15, (F.floor(x) == x)).otherwise(False)
    shown = x.cast("string")
    return F.when(whole, F.floor(x).cast("string")).when(~shown.contains("E"), shown).when(short.cast("double") == x, short).otherwise(F.replace(F.replace(shown, F.lit(".0E"), F.lit("e")), F.lit("E"), F.lit("e")))


def scalar_text(value: Column, kind: str) -> Column:
    return number_text(value) if kind == "float" else value.cast("string")
