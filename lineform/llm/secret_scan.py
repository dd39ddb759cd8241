"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions alone.

Candidates are found by patterns: assignments of passwords, tokens and keys, access key ids, and long hex
runs. The hash of each candidate's secret part is aggregated over the corpus by distinct repositories and
owners. A secret that several owners have is a copied example; one that a single owner has, with enough
different characters, looks live. Each secret part gets a span ``live`` or ``example`` by that; what one owner
has but looks like a placeholder gets none.

Defined cases: a null or empty text has no spans; rows are handled one by one, repeated ids and equal texts
included; a null owner or repository counts as one of its own; spans are code points, end exclusive, by start,
then kind as in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "live", "example")
#: Owners from which a secret counts as a copied example.
EXAMPLE_OWNERS = 3
#: Different characters that a live secret has, at least.
LIVE_CHARACTERS = 6

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs that are long enough are all that is left of the kind's matches, so the length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SPAN = "struct<start:int,end:int,kind:string,from:int,secret:string>"


def _matches(text: Column, kind: str, pattern: str, secret: int) -> Column:
    """An array of spans: leftmost matches that don't overlap; their places follow from the lengths of what lies between and of the matches before."""
    regex = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), F.regexp_extract_all(text, regex, F.lit(secret)).alias("part"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(done: Column, m: Column) -> Column:
        at = done["at"] + F.length(m["gap"])
        end = at + F.length(m["all"])
        own = F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), (end - F.length(m["part"])).alias("from"), m["part"].alias("secret")).cast(SPAN)
        keep = F.length(m["part"]) >= 8
        return F.struct(end.alias("at"), F.when(keep, F.concat(done["spans"], F.array(own))).otherwise(done["spans"]).alias("spans"))

    whole = F.filter(found, lambda m: m["all"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(whole, start, step)["spans"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> Column:
    """The base spans of a text, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    own = F.concat(_matches(text, "assign", ASSIGN, 2), _matches(text, "access", ACCESS, 0), _matches(text, "hex", HEX, 0))
    return _ordered(own)


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["from"].alias("from"), s["secret"].alias("secret")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["from"].alias("from"), s["secret"].alias("secret")))


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash, repositories, owners, occurrences: over a table of secret_hash, owner and repository."""
    each = found.groupBy("secret_hash", "owner", "repository").agg(F.count("*").alias("k"))
    by_owner = each.groupBy("secret_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("k").alias("k"))
    return by_owner.groupBy("secret_hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("k").alias("occurrences"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "lang") -> DataFrame:
    """doc_id, base (spans) and spans (base ones with live and example ones) of every row. A repository is an owner's value of repository_col. Texts are read once and don't move; of the hits alone, hashes are shuffled."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), candidates(F.col(f"`{text_col}`")).alias("base"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repository_col}`").cast("string").alias("repository"))
    rows = common.stored(own.withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("base") > 0).select("row", "owner", "repository", F.explode("base").alias("s")).withColumn("secret_hash", F.xxhash64("s.secret"))
    often = ownership(each)
    different = F.size(F.array_distinct(F.split(F.lower("s.secret"), "")))
    kind = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & (different >= LIVE_CHARACTERS), "live")
    mark = F.struct(F.col("s.from").alias("start"), F.col("s.end").alias("end"), F.col("kind"), F.col("s.from").alias("from"), F.col("s.secret").alias("secret"))
    marks = each.join(often, "secret_hash").withColumn("kind", kind).where("kind IS NOT NULL").groupBy("row").agg(F.collect_set(mark).alias("marks"))
    joined = rows.join(marks, "row", "left")
    return joined.select("doc_id", "base", _ordered(F.concat("base", F.coalesce("marks", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def _listed(column: Column | str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
