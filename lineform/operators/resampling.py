"""Confidence intervals by resampling whole clusters.

Each cluster has a Poisson(1) weight in each replicate, made from a hash of the cluster, the replicate and the
seed. So the weights need no driver, no order and no state, are the same after a lost task, and are summed
map-side. They are not those of another generator: intervals agree statistically, not digit by digit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1) weights beyond this one have a chance below 1e-13.
_MOST = 15


def poisson_weight(*of: Column) -> Column:
    """A Poisson(1) draw that depends on the given columns alone."""
    u = F.xxhash64(*of).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    reached, steps = 0.0, []
    for k in range(_MOST):
        reached += math.exp(-1) / math.factorial(k)
        steps.append(F.when(u >= F.lit(reached), 1).otherwise(0))
    return sum(steps[1:], steps[0])


def cluster_ratio(df: DataFrame, keys: list[str], cluster: str, num: str, den: str, replicates: int = 1000, seed: int = 12345, level: float = 0.95) -> DataFrame:
    """keys, clusters, ratio, low, high: sum(num) / sum(den) and its percentile interval over resampled clusters.

    Clusters with no denominator are left out; one cluster gives its ratio as both ends; none gives no row.
    """
    own = df.groupBy(*keys, cluster).agg(F.sum(F.col(num).cast("double")).alias("__a"), F.sum(F.col(den).cast("double")).alias("__b")).where("__b <> 0")
    whole = own.groupBy(*keys).agg(F.count("*").alias("clusters"), F.try_divide(F.sum("__a"), F.sum("__b")).alias("ratio"))
    drawn = own.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("__w", poisson_weight(F.col(cluster), F.col("__r"), F.lit(seed)))
    each = drawn.groupBy(*keys, "__r").agg(F.try_divide(F.sum(F.col("__w") * F.col("__a")), F.sum(F.col("__w") * F.col("__b"))).alias("x"))
    sorted_ = each.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tail, n = (1 - level) / 2, F.size("xs")
    low = F.get("xs", F.floor(n * tail).cast("int"))
    high = F.get("xs", F.least(n, F.ceil(n * (1 - tail)).cast("int")) - 1)
    ends = sorted_.select(*keys, low.alias("low"), high.alias("high"))
    one = F.col("clusters") == 1
    joined = whole.join(ends, keys, "left") if keys else whole.crossJoin(ends)  # one row each
    return joined.select(*keys, "clusters", "ratio", F.when(one, F.col("ratio")).otherwise(F.col("low")).alias("low"), F.when(one, F.col("ratio")).otherwise(F.col("high")).alias("high"))
