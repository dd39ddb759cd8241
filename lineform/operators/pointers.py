"""JSON as rows of pointers and values, and back; recodings of values with their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineform.functions.lexical import bound


def escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _depth(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    brackets = F.translate(F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\]++|\\\\.)*+"', ""), r"[^\[\]{}]", ""), "{}", "[]")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        return bound(s["at"] + F.when(c == "[", 1).otherwise(-1), lambda at: F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most")))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step, lambda s: s["most"])


def flatten(docs: DataFrame, key: str = "doc_id", value: str = "v", most_depth: int = 64) -> DataFrame:
    """key, pointer, json: the leaves of variants (scalars, null, empty arrays and objects). A first pass finds how deep they are (an error beyond most_depth); then each document is opened in place, a level at a time."""
    deepest = docs.agg(F.max(_depth(F.to_json(value))).alias("d")).first().d or 0
    if deepest > most_depth:
        raise ValueError(f"values are nested {deepest} levels deep, more than {most_depth}")
    none = F.lit(None).cast("string")

    def opened(e: Column) -> Column:
        below = lambda name, w: F.struct(F.concat(e["pointer"], F.lit("/"), name).alias("pointer"), none.alias("json"), w.alias("v"))
        members = F.transform(F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>")), lambda m: below(escaped(m["key"]), m["value"]))
        items = F.transform(F.try_variant_get(e["v"], "$", "array<variant>"), lambda w, i: below(i.cast("string"), w))
        leaf = lambda text: F.array(F.struct(e["pointer"].alias("pointer"), text.alias("json"), F.lit(None).cast("variant").alias("v")))
        kids = bound(F.coalesce(items, members), lambda found: F.when(F.size(found) > 0, found).otherwise(leaf(F.to_json(e["v"]))))
        return F.when(e["json"].isNotNull() | e["v"].isNull(), leaf(e["json"])).otherwise(kids)

    found = docs.select(key, F.array(F.struct(F.lit("").alias("pointer"), none.alias("json"), F.col(value).alias("v"))).alias("es"))
    for _ in range(deepest):
        found = found.withColumn("es", F.flatten(F.transform("es", opened)))
    each = found.select(key, F.explode("es").alias("e"))
    return each.select(key, "e.pointer", F.coalesce("e.json", F.to_json("e.v")).alias("json"))


def unflatten(leaves: DataFrame, key: str = "doc_id", arrays: bool = True) -> DataFrame:
    """key, json: the values that the pointers make up, from the deepest up. Members named 0, 1, ... without a gap make an array where ``arrays`` is set; members of objects are in order of their names.

    Leaves are dealt by document once; each level is one aggregate of all rows, in which rows above it stay as they are.
    """
    levels = lambda: F.length("pointer") - F.length(F.replace("pointer", F.lit("/"), F.lit("")))
    deepest = leaves.agg(F.max(levels()).alias("d")).first().d or 0
    rows = leaves.select(key, "pointer", "json").repartition(key)
    for depth in range(deepest, 0, -1):
        name = F.substring_index("pointer", "/", -1)
        parent = F.substring(F.col("pointer"), F.lit(1), F.length("pointer") - F.length(name) - 1)
        at = rows.withColumn("at", levels() == depth)
        own = at.groupBy(key, F.when(F.col("at"), parent).otherwise(F.col("pointer")).alias("parent"), "at").agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "json"))).alias("ms"))
        n = F.size("ms")
        numbers = F.transform("ms", lambda m: F.when(m["name"].rlike(r"\A(0|[1-9][0-9]*)\z"), m["name"].try_cast("int")))
        listed = F.lit(arrays) & F.forall(numbers, lambda i: i.isNotNull()) & (F.array_max(numbers) == n - 1)
        items = F.transform(F.array_sort(F.transform("ms", lambda m: F.struct(m["name"].try_cast("int").alias("i"), m["json"].alias("json")))), lambda m: m["json"])
        quoted = lambda t: F.to_json(F.array(F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))))
        members = F.transform("ms", lambda m: F.concat(F.regexp_replace(quoted(m["name"]), r"\A\[|\]\z", ""), F.lit(":"), m["json"]))
        text = F.when(listed, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
        rows = own.select(key, F.col("parent").alias("pointer"), F.when(F.col("at"), text).otherwise(F.get("ms", 0)["json"]).alias("json"))
    return rows.select(key, "json")


def payload_bytes(leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, leaves, bytes: the content of all leaves without names, quotes and punctuation."""
    bare = F.when(F.col("json").startswith('"'), F.from_json(F.concat(F.lit("["), F.col("json"), F.lit("]")), "array<string>")[0]).otherwise(F.col("json"))
    return leaves.groupBy(key).agg(F.count("*").alias("leaves"), F.sum(F.octet_length(bare)).alias("bytes"))


# ---- recodings: each is a column there and a column back; a value that isn't covered is null


def coded(value: Column, codes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), value)


def uncoded(code: Column, codes: dict[str, str]) -> Column:
    return coded(code, {v: k for k, v in codes.items()})


def unprefixed(value: Column, prefix: str, width: int) -> Column:
    """prefix and a number of fixed width as the number."""
    return F.when(value.rlike(rf"\A\Q{prefix}\E[0-9]{{{width}}}\z"), F.substring(value, len(prefix) + 1, width).cast("bigint"))


def prefixed(number: Column, prefix: str, width: int) -> Column:
    return F.when(number.between(0, 10**width - 1), F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")))


def scaled(value: Column, factor: int) -> Column:
    """A decimal as a whole number of 1/factor parts; null where it isn't whole."""
    exact = value.cast("decimal(28,10)") * factor
    return F.when(exact == F.floor(exact), exact.cast("bigint"))


def unscaled(number: Column, factor: int) -> Column:
    return (number.cast("decimal(28,0)") / F.lit(factor).cast("decimal(10,0)")).cast("double")


def minutes(clock: Column) -> Column:
    """HH:MM as minutes of the day."""
    return F.when(clock.rlike(r"\A([01][0-9]|2[0-3]):[0-5][0-9]\z"), F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int"))


def clock(minute: Column) -> Column:
    return F.when(minute.between(0, 1439), F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0")))


def code_scheme(values: DataFrame, value: str) -> DataFrame:
    """value, code: the shortest beginning of each distinct value that no other one has."""
    own = values.select(value).where(F.col(value).isNotNull()).distinct()
    heads = own.select(value, F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda n: F.substring(F.col(value), F.lit(1), n))).alias("i", "head"))
    alone = heads.withColumn("n", F.count("*").over(Window.partitionBy("head"))).where((F.col("n") == 1) | (F.col("head") == F.col(value)))
    return alone.groupBy(value).agg(F.min_by("head", "i").alias("code"))
