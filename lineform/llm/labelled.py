"""Labelled rows for the classifiers: who is held out, and the bounded sample that a model is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineform.llm import common

FOLDS = 5


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id in decimal is divisible by folds; a null id is not."""
    return F.coalesce(common.lit_crc_mod(id_column, folds) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = FOLDS) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled rows that are not held out: those whose ids hash lowest.

    The sampled ids (at most ``most``) are broadcast to a scan of the documents; the sample is spread over the shuffle
    partitions and written to the checkpoint folder, so that later passes read it alone, in parallel. Of repeated
    ids the least label and the least text count, once.
    """
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return common.cut(one.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"))
