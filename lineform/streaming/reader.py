"""Documents that come in fragments, read record by record.

Each fragment has a document key, its number and bytes of text; it may come twice or out of order, and may end within
a character. A micro-batch closes lines; these are typed by the same expressions as whole documents, and every record
is given out once, with its line, its index among the valid ones and its errors. What stays between batches are
tables: for each open document its open line, header and counts; fragments that came too early; claimed values of
unique fields. They are written under the batch's number, so a batch that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineform.contract import Contract
from lineform.functions import lexical as L
from lineform.operators import documents as D
from lineform.operators.staging import folder

_STATE = "doc string, next_seq int, line int, header string, header_line int, open binary, received long, valid long, ended boolean, terminated boolean, broken boolean"
_EARLY = "doc string, seq int, data binary, last boolean"
_CLAIMS = "doc string, field string, value string"


class StreamReader:
    """Reads documents of one contract; ``path`` (in the shared folder unless given) keeps its state."""

    def __init__(self, spark: SparkSession, contract: Contract, path: str | None = None):
        self.spark, self.contract = spark, contract
        self.path = path or f"{folder(spark).rstrip('/')}/reader-{id(self):x}"
        self.batch = -1

    def _table(self, name: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{batch}/{name}")

    def _keep(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        at = f"{self.path}/{batch}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def push(self, fragments: DataFrame, batch: int | None = None) -> DataFrame:
        """doc, line, index, record, errors of the lines that these fragments (doc, seq, data, last) close; index is null for invalid ones."""
        batch = self.batch + 1 if batch is None else batch
        self.batch = batch
        state, early, claims = self._table("state", batch - 1, _STATE), self._table("early", batch - 1, _EARLY), self._table("claims", batch - 1, _CLAIMS)
        own = fragments.select(F.col("doc").cast("string").alias("doc"), F.col("seq").cast("int").alias("seq"), F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"), F.coalesce("last", F.lit(False)).alias("last"))
        waiting = early.unionByName(own).dropDuplicates(["doc", "seq"]).join(state.select("doc", "next_seq", "ended"), "doc", "left").na.fill({"next_seq": 0, "ended": False}).where("seq >= next_seq AND NOT ended")
        place = F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1 + F.col("next_seq")
        waiting = self._keep(waiting.withColumn("ready", place == F.col("seq")), "waiting", batch)
        self._keep(waiting.where("NOT ready").select("doc", "seq", "data", "last"), "early", batch)

        by = waiting.where("ready").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("data").cast("string").alias("text")))).alias("xs"), F.max("seq").alias("seq"), F.max("last").alias("last"))
        both = by.join(state, "doc", "left").withColumns({"line": F.coalesce("line", F.lit(0)), "text": F.concat(F.coalesce(F.col("open").cast("string"), F.lit("")), F.array_join(F.transform("xs", lambda x: x["text"]), ""))})
        pieces = F.split("text", "\n", -1)
        rest = F.element_at("parts", -1)
        both = both.withColumn("parts", pieces).withColumn("closed", F.when(F.col("last") & ~L.is_blank(F.make_valid_utf8(rest)), F.col("parts")).otherwise(F.slice("parts", F.lit(1), F.size("parts") - 1)))
        bare = lambda x, i: F.when(F.col("line") + i == 0, F.regexp_replace(x, "^\\x{feff}", "")).otherwise(x)
        numbered = F.transform("closed", lambda x, i: F.struct((F.col("line") + i + 1).alias("line"), F.rtrim(bare(F.make_valid_utf8(x), i), F.lit("\r")).alias("text")))
        both = both.withColumn("found", F.filter(numbered, lambda x: ~L.is_blank(x["text"])))
        first = F.get("found", 0)
        new = F.col("header").isNull()
        both = both.select(
            "doc",
            F.when(new, first["text"]).otherwise(F.col("header")).alias("text"),
            F.when(new, first["line"]).otherwise(F.col("header_line")).alias("header_line"),
            F.when(new, F.slice("found", F.lit(2), F.greatest(F.size("found") - 1, F.lit(0)))).otherwise(F.col("found")).alias("rest"),
            (F.col("seq") + 1).alias("next_seq"),
            (F.col("line") + F.size("closed")).alias("line"),
            F.when(F.col("last"), F.lit(b"")).otherwise(rest.cast("binary")).alias("open"),
            F.coalesce("last", F.lit(False)).alias("ended"),
            L.is_blank(F.make_valid_utf8(rest)).alias("terminated"),
            F.coalesce("received", F.lit(0)).alias("received"),
            F.coalesce("valid", F.lit(0)).alias("valid"),
        )
        both = self._keep(both, "both", batch)
        heads = D.headers(both.where("text IS NOT NULL"), self.contract, "doc").drop("header_line").join(both.select("doc", "header_line", "rest"), "doc")
        typed = D.typed(heads, self.contract, "doc")
        rows = self._keep(D.unique_checked(typed, self.contract, "doc", claims).select("doc", "line", "record", "errors"), "rows", batch)
        if any(f.unique for f in self.contract.fields):
            claims = claims.unionByName(D.claims_of(rows, self.contract, "doc"))
        self._keep(claims, "claims", batch)
        counts = rows.groupBy("doc").agg(F.count("*").alias("r"), F.count_if(F.size("errors") == 0).alias("g"), F.max_by(F.size("errors") > 0, "line").alias("bad"))
        done = both.join(counts, "doc", "left").na.fill({"r": 0, "g": 0})
        broken = F.col("ended") & ~F.col("terminated") & F.coalesce("bad", F.lit(False))
        fresh = done.select("doc", "next_seq", "line", F.col("text").alias("header"), "header_line", "open", (F.col("received") + F.col("r")).alias("received"), (F.col("valid") + F.col("g")).alias("valid"), "ended", "terminated", broken.alias("broken"))
        self._keep(state.join(fresh.select("doc"), "doc", "left_anti").unionByName(fresh), "state", batch)
        good = F.size("errors") == 0
        index = F.count_if(good).over(Window.partitionBy("doc").orderBy("line")) - 1 + F.col("valid")
        return rows.join(both.select("doc", "valid"), "doc").select("doc", "line", F.when(good, index).alias("index"), "record", "errors")

    def progress(self) -> DataFrame:
        """doc, expected, received, valid of every document so far."""
        state = self._table("state", self.batch, _STATE)
        heads = D.headers(state.where("header IS NOT NULL").select("doc", F.col("header").alias("text")), self.contract, "doc").select("doc", "n", "header_errors")
        return state.join(heads, "doc", "left").select("doc", F.col("n").alias("expected"), "received", "valid", "ended", "terminated", "broken", "header_errors")

    def results(self) -> DataFrame:
        """Of the documents that have ended: expected, received, valid, missing, excess, terminated, truncated, complete."""
        p = self.progress().where("ended")
        missing, excess = F.greatest(F.coalesce(F.col("expected") - F.col("received"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.col("received") - F.col("expected"), F.lit(0)), F.lit(0))
        return p.select("doc", "expected", "received", "valid", missing.alias("missing"), excess.alias("excess"), "terminated", (F.col("broken") | (missing > 0)).alias("truncated"), ((F.col("valid") == F.col("received")) & F.coalesce(F.col("expected") == F.col("received"), F.lit(False)) & (F.size(F.coalesce("header_errors", F.array(F.struct(F.lit("E01"), F.lit(""))).cast(f"array<{D.ERROR}>"))) == 0)).alias("complete"))


def read_stream(fragments: DataFrame, reader: StreamReader, sink: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that pushes each micro-batch of a stream of fragments and writes the records under ``sink``, a folder for each batch."""

    def push(df: DataFrame, batch: int) -> None:
        reader.push(df, batch).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return fragments.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).start()
