"""Orders, top rows, cuts, hold-outs and design matrices."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranked_by(value: Column, order: list[str]) -> Column:
    """A sort key that puts values in the given order, others after them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), value).cast("int"), F.lit(0)) + F.when(value.isin(*order), 0).otherwise(len(order) + 1)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; ties have to be settled by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def hold_out(index: Column, share: int = 5) -> Column:
    """Whether a row is held out: every share-th by its index."""
    return F.pmod(index, F.lit(share)) == 0


def coverage(df: DataFrame, keys: list[str], held: Column, value: str) -> DataFrame:
    """keys, held, covered, share: how many held-out rows have a value that the others have too."""
    known = df.where(~held).select(*keys, value).distinct().withColumn("__known", F.lit(1))
    rows = df.where(held).join(known, [*keys, value], "left")
    return rows.groupBy(*keys).agg(F.count("*").alias("held"), F.count("__known").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("held"), 6))


def cut_points(length: Column, parts: int) -> Column:
    """Equally spaced cuts inside a length."""
    return F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.floor(length * i / (parts + 1)))


def token_limits(total: Column, steps: int = 20) -> Column:
    """The limits k / steps of a total, rounded half up in whole numbers."""
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.floor((2 * k * total + steps) / (2 * steps)))


def design_matrix(spark: SparkSession, **factors: list) -> DataFrame:
    """A row for each combination of the factors' levels, numbered in order; the factors are given lists."""
    names = list(factors)
    rows = [(i, *(str(x) for x in combination)) for i, combination in enumerate(itertools.product(*factors.values()))]
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"`{n}` string" for n in names))


def stratum(df: DataFrame, factors: list[str], done: DataFrame) -> DataFrame:
    """The combinations of a design that have not been run."""
    return df.join(done.select(*factors).distinct(), factors, "left_anti")


def distinct_without(df: DataFrame, ignored: list[str]) -> DataFrame:
    """One row: rows, and distinct rows without the ignored columns."""
    kept = [c for c in df.columns if c not in ignored]
    return df.groupBy(*kept).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
