"""Running sums over groups of any size without one task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: Column, sums: dict[str, str]) -> DataFrame:
    """df with, for each new name -> column of sums, the sum over the rows of the same keys up to this one.

    bucket must ascend with order; null keys are groups too. Sums by bucket are summed up along the buckets; rows are ordered only
    within their bucket.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    per = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in dict.fromkeys(sums.values())])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_of__bucket"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{n}") for n, c in sums.items()])
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_l_{n}": F.sum(c).over(within) for n, c in sums.items()})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.col("_bucket").eqNullSafe(F.col("_of__bucket")))
    joined = local.join(bases, same).withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in sums})
    return joined.select(*[c for c in df.columns if c != "_bucket"], *sums)
