"""Damaged documents: find the document within an answer, list its invalid items, merge corrections, continue.

All steps are columns and joins by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineform.contract import Contract
from lineform.functions import lexical as L
from lineform.operators import documents as D
from lineform.operators.staging import spread, staged

FENCE = r"^\s*(```|~~~)"


def extracted(text: Column, prefix: str) -> Column:
    """The document within an answer: from its header line, without fences; a fence that was open before it ends it."""
    every = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    fence = lambda x: x.rlike(FENCE)

    def heads(x: Column) -> Column:
        bare = F.regexp_replace(L.trimmed(x), "^\\x{feff}+", "")
        return (bare == prefix) | bare.startswith(prefix + "|")

    at = F.array_position(F.transform(every, heads), F.lit(True)).cast("int")
    body = F.slice(every, F.greatest(at, F.lit(1)), F.size(every))
    close = F.array_position(F.transform(body, fence), F.lit(True)).cast("int")
    inside = (at > 1) & F.exists(F.slice(every, F.lit(1), F.greatest(at - 1, F.lit(0))), fence)
    kept = F.when(inside & (close > 0), F.slice(body, F.lit(1), F.greatest(close - 1, F.lit(0)))).when(inside, body).otherwise(F.filter(body, lambda x: ~fence(x)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+\z", "")


def _physical(docs: DataFrame, key: str) -> DataFrame:
    """key, pos, line, text of significant lines; pos 0 is the header."""
    return D.lines(docs).select(key, F.posexplode("lines").alias("pos", "l")).select(key, "pos", "l.line", "l.text")


def invalid_items(docs: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """key, item, is_header, lines, text, codes: invalid lines in order; neighbours that are fragments of one record are one item."""
    # written before they are tested: the test would sink below the steps that make the headers, which would be made again for each use
    heads = staged(D.headers(docs, contract, key).select(key, F.col("header_line").alias("line"), F.col("header_errors").alias("errors"))).where("size(errors) > 0")
    found = staged(D.records(docs, contract, key).where("size(errors) > 0").select(key, "line", "errors").unionByName(heads))
    bad = _physical(docs, key).join(found, [key, "line"])
    core, most = len(contract.core), len(contract.fields)
    lined = bad.select(key, "pos", "line", "text", F.transform("errors", lambda e: e["code"]).alias("codes"), L.field_count(F.col("text")).alias("k"))
    by = Window.partitionBy(key).orderBy("pos")
    # two lines in a row make one record of core to most fields, which needs no third: of a run of such pairs, every second one is joined
    before, k = F.lag("pos").over(by), F.lag("k").over(by)
    joins = F.coalesce((before > 0) & (before == F.col("pos") - 1) & (k < core) & (F.col("k") < core) & (k + F.col("k") - 1).between(core, most), F.lit(False))
    runs = lined.withColumn("joins", joins).withColumn("from", F.max(F.when(~F.col("joins"), F.col("pos"))).over(by))
    parts = runs.withColumn("own", ~F.col("joins") | ((F.col("pos") - F.col("from")) % 2 == 0)).withColumn("item", F.sum(F.col("own").cast("int")).over(by).cast("int") - 1)
    both = parts.groupBy(key, "item").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "text", "codes"))).alias("ps"))  # two at most
    return both.select(key, "item", (F.get("ps", 0)["pos"] == 0).alias("is_header"), F.transform("ps", lambda p: p["line"]).alias("lines"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("text"), F.flatten(F.transform("ps", lambda p: p["codes"])).alias("codes"))


DROP = "-"


def requests(docs: DataFrame, contract: Contract, most_items: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, items (their number), prompt, hint: what to ask for so that the invalid items of a document are corrected, and about how many tokens the answer needs."""
    items = invalid_items(docs, contract, key)
    if most_items is not None:
        items = items.where(F.col("item") < most_items)
    place = F.concat(F.lit("[L"), F.get("lines", 0).cast("string"), F.when(F.size("lines") > 1, F.concat(F.lit("-L"), F.element_at("lines", -1).cast("string"))).otherwise(F.when(F.col("is_header"), " header").otherwise("")), F.lit("] "))
    entry = F.concat(place, F.replace("text", F.lit("\n"), F.lit(" / ")), F.lit("  <- "), F.array_join("codes", ", "))
    by = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("item", entry.alias("entry")))).alias("es"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("items"))
    head = _physical(docs, key).where("pos = 0").select(key, F.col("text").alias("head"))
    k = F.col("items").cast("string")
    prompt = F.concat_ws("\n", F.concat(F.lit("Correct only these lines of a document with the header "), F.coalesce("head", F.lit(f"{contract.prefix}|n=0")), F.lit(":")), F.array_join(F.transform("es", lambda x: x["entry"]), "\n"), F.concat(F.lit(f"Answer with {contract.prefix}|n="), k, F.lit(f" and one line for each, in this order; {DROP} for a line that is no record.")))
    return by.join(head, key, "left").select(key, "items", prompt.alias("prompt"), F.greatest(F.lit(64), F.floor(F.col("chars") / 2.5) + 16 * (F.col("items") + 1)).alias("hint"))


def _answered(answers: DataFrame, contract: Contract, key: str) -> DataFrame:
    """key, item, cand: the lines of an answer after its header, if it has one."""
    rows = D.lines(staged(spread(answers.select(key, extracted(F.col("answer"), contract.prefix).alias("text")), key)))
    first = L.trimmed(F.get("lines", 0)["text"])
    skip = F.when((first == contract.prefix) | first.startswith(contract.prefix + "|"), 2).otherwise(1)
    body = F.slice("lines", skip, F.greatest(F.size("lines"), F.lit(1)))
    return rows.select(key, F.posexplode(F.transform(body, lambda x: L.trimmed(x["text"]))).alias("item", "cand"))


def merge(docs: DataFrame, answers: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """key, text, replaced, dropped, unresolved (lines) of every document, with the corrections of ``answers`` (key, answer) in place.

    The k-th line of an answer is for the k-th invalid item. A correction counts only if it is a right record under
    the (corrected) header and claims no unique value that a kept record or an earlier correction has; - drops the
    item, and so does a copy of a line that is there already. Whatever isn't resolved stays as it was.
    """
    # written, as reading would else extract a text for each use
    base = staged(spread(docs.select(key, extracted(F.col("text"), contract.prefix).alias("text")), key))
    physical = staged(_physical(base, key))
    items = invalid_items(base, contract, key).select(key, "item", "is_header", "lines")
    pairs = staged(items.join(_answered(answers, contract, key), [key, "item"], "left"))
    asked = pairs.where("is_header AND cand IS NOT NULL").select(key, F.col("cand").alias("text"))
    header = staged(D.headers(asked, contract, key).select(key, "header_errors")).where("size(header_errors) = 0").select(key, F.lit(True).alias("good"))
    heads = physical.where("pos = 0").select(key, F.col("text").alias("head")).join(asked.join(header, key).select(key, F.col("text").alias("new_head")), key, "left")
    lines_of = pairs.select(key, "item", "is_header", F.posexplode("lines").alias("part", "line"))
    kept = physical.where("pos > 0").join(lines_of, [key, "line"], "left_anti")
    texts = kept.select(key, L.trimmed(F.col("text")).alias("cand"), F.lit(True).alias("there")).distinct()
    first = F.min("item").over(Window.partitionBy(key, "cand"))
    tried = staged(pairs.where("NOT is_header AND cand IS NOT NULL").withColumn("first", first).join(texts, [key, "cand"], "left"))
    fresh = (F.col("cand") != DROP) & (F.col("cand") != "") & F.col("there").isNull() & (F.col("item") == F.col("first"))
    probes = tried.where(fresh).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("item", "cand"))).alias("cs"))
    old = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ks"))
    probe = staged(probes.join(old, key, "left").join(heads, key, "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<struct<line:int,text:string>>"))))
    body = F.concat(F.array(F.coalesce("new_head", "head", F.lit(f"{contract.prefix}|n=0"))), F.transform("ks", lambda x: x["text"]), F.transform("cs", lambda x: x["cand"]))
    judged = D.records(spread(probe, key).select(key, F.array_join(body, "\n").alias("text")), contract, key).where(F.size("errors") == 0).select(key, "line")
    right = probe.select(key, F.posexplode("cs").alias("j", "c"), (F.size("ks") + 2).alias("from")).select(key, F.col("c.item").alias("item"), (F.col("from") + F.col("j")).alias("line")).join(judged, [key, "line"]).select(key, "item", F.lit(True).alias("right"))
    found = tried.join(staged(right), [key, "item"], "left").withColumn("right", F.coalesce("right", F.lit(False)))
    original = F.max("right").over(Window.partitionBy(key, "cand"))
    state = F.when((F.col("cand") == DROP) | F.col("there") | ((F.col("item") > F.col("first")) & original), "dropped").when(F.col("right"), "replaced").otherwise("unresolved")
    states = found.select(key, "item", state.alias("state"), "cand")
    heads_state = pairs.where("is_header").join(header, key, "left").select(key, "item", F.when(F.col("good"), "replaced").otherwise("unresolved").alias("state"), "cand")
    known = lines_of.join(states.unionByName(heads_state), [key, "item"], "left").select(key, "line", "part", F.coalesce("state", F.lit("unresolved")).alias("state"), "cand")
    merged = physical.join(known, [key, "line"], "left")
    text = F.when(F.col("state").isNull() | (F.col("state") == "unresolved"), F.col("text")).when((F.col("state") == "replaced") & (F.col("part") == 0), F.col("cand"))
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("line")))).alias(s)
    by = merged.withColumn("new", text).groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("line", "new")))).alias("ls"), of("replaced"), of("dropped"), of("unresolved"))
    none = F.array().cast("array<int>")
    return base.select(key).join(by, key, "left").select(key, F.coalesce(F.array_join(F.transform("ls", lambda x: x["new"]), "\n"), F.lit("")).alias("text"), *(F.coalesce(c, none).alias(c) for c in ("replaced", "dropped", "unresolved")))


def continued(docs: DataFrame, answers: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """key, text, code: documents that end before n records, with the lines of their continuation (answers: key, answer) after them. A broken last line goes first; code is D_EXPECTED_COUNT where the number of lines is still not n."""
    base = staged(spread(docs.select(key, extracted(F.col("text"), contract.prefix).alias("text")), key))
    state = D.diagnostics(base, contract, key).select(key, "n", "truncated", "received", F.get("invalid_lines", F.size("invalid_lines") - 1).alias("last_bad"))
    more = _answered(answers, contract, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("item", "cand"))).alias("ms"))
    rows = D.lines(base).join(state, key).join(more, key, "left")
    broken = F.col("truncated") & (F.element_at("lines", -1)["line"] == F.col("last_bad"))
    own = F.transform(F.when(broken, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines")), lambda x: x["text"])
    short = F.size(own) - 1 < F.col("n")
    lines_of = F.when(short & F.col("ms").isNotNull(), F.concat(own, F.transform("ms", lambda x: x["cand"]))).otherwise(F.transform("lines", lambda x: x["text"]))
    out = rows.withColumn("all", lines_of)
    return out.select(key, F.array_join("all", "\n").alias("text"), F.when(F.size("all") - 1 != F.col("n"), "D_EXPECTED_COUNT").alias("code"))
