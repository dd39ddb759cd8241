"""Statistics over groups: ratios, quantiles, intervals, fits, crossings and exact money, as columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_of_sums(a: Column, b: Column) -> Column:
    """Sum over sum; null where the denominator is 0."""
    return F.try_divide(F.sum(a), F.sum(b))


def poisoned_sum(x: Column, valid: Column) -> Column:
    """The sum, or null if any row isn't valid or has no value."""
    return F.when(F.bool_and(valid & x.isNotNull()), F.sum(x))


def nearest_rank(x: str, p: float) -> Column:
    """The value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval; (null, null) for no trials, and exact 0 and 1 at the ends."""
    p = successes / n
    below = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return F.when(n > 0, F.when(successes == 0, 0.0).otherwise(middle - half)), F.when(n > 0, F.when(successes == n, 1.0).otherwise(middle + half))


def interpolated_crossing(df: DataFrame, keys: list[str], x: str, y: str, threshold: float) -> DataFrame:
    """keys and x_cross: where y first reaches the threshold along x, linearly interpolated; beyond the last x by the last slope, infinite if that doesn't rise."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.withColumn("px", F.lag(x).over(w)).withColumn("py", F.lag(y).over(w))
    at = F.when(F.col("py").isNull() | (F.col("py") >= threshold), F.col(x)).otherwise(F.try_divide((threshold - F.col("py")) * (F.col(x) - F.col("px")), F.col(y) - F.col("py")) + F.col("px"))
    reached = F.min_by(F.when(F.col(y) >= threshold, at), F.when(F.col(y) >= threshold, F.col(x)))
    slope = F.try_divide(F.col(y) - F.col("py"), F.col(x) - F.col("px"))
    beyond = F.max_by(F.when(slope > 0, F.col(x) + (threshold - F.col(y)) / slope).otherwise(F.lit(float("inf"))), x)
    return rows.groupBy(*keys).agg(F.coalesce(reached.cast("double"), beyond).alias("x_cross"))


def persistent_crossing(df: DataFrame, keys: list[str], x: str, difference: str) -> DataFrame:
    """keys and x_from: the least measured x from which on all differences are positive; null if the last isn't."""
    bad = F.max(F.when(F.coalesce(F.col(difference) <= 0, F.lit(True)), F.col(x))).over(Window.partitionBy(*keys))
    rows = df.withColumn("__bad", bad)
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("__bad").isNull() | (F.col(x) > F.col("__bad")), F.col(x))).alias("x_from"))


#: Critical values of Student's t at 0.975 for 1 to 30 degrees of freedom, and for up to 40, 60, 120 and more. Fixed values.
T975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
T975_BEYOND = ((40, 2.021), (60, 2.000), (120, 1.980))


def t_interval(x: str) -> Column:
    """struct(mean, low, high) of a group at 95 %; ends are null for fewer than two values."""
    n, mean = F.count(x), F.avg(x)
    free = n - 1
    t = F.when(free <= len(T975), F.get(F.array(*map(F.lit, T975)), (free - 1).cast("int")))
    for most, value in T975_BEYOND:
        t = t.when(free <= most, F.lit(value))
    half = F.when(n >= 2, t.otherwise(F.lit(1.960)) * F.stddev_samp(x) / F.sqrt(n))
    return F.struct(mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


def linear_quantile(x: str, p: float) -> Column:
    """The quantile by linear interpolation between ranks (type 7)."""
    return F.percentile(F.col(x).cast("double"), p)


def censored_quantile(df: DataFrame, keys: list[str], x: str, p: float) -> DataFrame:
    """keys, value, determined: type-7 quantile where null stands for a value beyond all others; undetermined if one takes part."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(F.col(x).asc_nulls_last())) - 1).withColumn("__h", (F.count("*").over(w) - 1) * F.lit(p))
    lo, hi = F.floor("__h"), F.ceil("__h")
    pick = lambda at: F.max(F.when(F.col("__i") == at, F.col(x))).cast("double")
    by = rows.groupBy(*keys).agg(pick(lo).alias("lo"), pick(hi).alias("hi"), F.first("__h").alias("h"))
    value = F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))
    return by.select(*keys, value.alias("value"), value.isNotNull().alias("determined"))


def weighted_savings(df: DataFrame, keys: list[str], small: str, large: str) -> DataFrame:
    """keys, by_sums (1 - sum / sum), by_rows (mean of savings), wins (rows that save), rows."""
    saving = 1 - F.try_divide(small, large)
    return df.groupBy(*keys).agg((1 - F.try_divide(F.sum(small), F.sum(large))).alias("by_sums"), F.avg(saving).alias("by_rows"), F.count_if(F.col(small) < F.col(large)).alias("wins"), F.count("*").alias("rows"))


def numeric_summary(x: str) -> Column:
    """struct(n, mean, median, deviation, low, high, distinct); null if any value is missing."""
    none = F.bool_or(F.col(x).isNull())
    return F.when(~none, F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("deviation"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct(x).alias("distinct")))


def usability_score(answers: Column) -> Column:
    """The score of ten answers from 1 to 5 (odd ones count r - 1, even ones 5 - r, times 2.5); null for any other form."""
    ok = (F.size(answers) == 10) & F.forall(answers, lambda r: F.coalesce((r >= 1) & (r <= 5) & (r == F.floor(r)), F.lit(False)))
    total = F.aggregate(F.transform(answers, lambda r, i: F.when(i % 2 == 0, r - 1).otherwise(5 - r)), F.lit(0.0), lambda a, r: a + r)
    return F.when(ok, total * 2.5)


def marginal_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and slope between the two largest x."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc())
    ranked = df.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return ranked.groupBy(*keys).agg(((F.max(F.when(F.col("r") == 1, F.col(y))) - F.max(F.when(F.col("r") == 2, F.col(y)))) / (F.max(F.when(F.col("r") == 1, F.col(x))) - F.max(F.when(F.col("r") == 2, F.col(x))))).alias("slope"))


def first_appearance_codes(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value and its code: 0 for the value that appears first."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("first"))
    return firsts.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).alias("code"))


def multiset_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of bag sizes: identical, excess (known values too often) and foreign rows of left against right."""
    a = left.groupBy(key).agg(F.count("*").alias("na"))
    b = right.groupBy(key).agg(F.count("*").alias("nb"))
    both = a.join(b, key, "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(F.sum(F.least(na, nb)).alias("identical"), F.sum(F.when(nb > 0, F.greatest(na - nb, F.lit(0))).otherwise(0)).alias("excess"), F.sum(F.when(nb == 0, na).otherwise(0)).alias("foreign"), F.sum(F.greatest(nb - na, F.lit(0))).alias("missing"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def micro_units(amount: Column) -> Column:
    """Money as whole millionths, rounded half up, so that sums are exact."""
    return F.round(amount.cast("decimal(30,10)") * 1_000_000, 0).cast("long")
