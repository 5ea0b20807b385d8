"""Running totals and numbers of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column], store: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """df with, for each of sums, the sum over the rows of the group by up to this one in the order; no task holds a group.

    Rows are split into ranges of (by, order); equal rows may be split too. A total is that of the row's part of its group and
    those of the group's earlier parts. Only the group that goes on at the start of a range has such parts, so that
    table has a row a range at most and is broadcast. store writes the split rows, which are read twice.
    """
    part, tie = "_part", "_tie"
    keys = [F.asc_nulls_first(c) if isinstance(c, str) else c for c in [*by, *order]]
    columns = {f"_x{i}": x for i, x in enumerate(sums.values())}
    tied = df.withColumns(columns).withColumn(tie, F.monotonically_increasing_id())
    placed = store(tied.repartitionByRange(*keys, F.col(tie)).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, part).agg(*[F.sum(x).alias(x) for x in columns])
    counts = counts.withColumns({f"_b{x}": F.sum(x).over(before) for x in columns}).filter(F.col("_b_x0").isNotNull())
    base = counts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col(part).alias("_of_part"), *[f"_b{x}" for x in columns])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), by, F.col(part) == F.col("_of_part"))
    along = Window.partitionBy(*by, part).orderBy(*keys, tie).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"_l{x}": F.sum(x).over(along) for x in columns}).join(F.broadcast(base), same, "left")
    return local.select(*df.columns, *[(F.col(f"_l{x}") + F.coalesce(f"_b{x}", F.lit(0))).alias(n) for n, x in zip(sums, columns, strict=True)])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with name: the row's place, from 0, in the order of its group by; no task holds a group."""
    out = running_totals(df, by, order, {name: F.lit(1).cast("long")}, store)
    return out.withColumn(name, F.col(name) - 1)


def large_groups(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """_h: the hashes of groups of more than limit rows: one in limit rows at most. Groups whose hashes collide count as one."""
    return df.groupBy(F.xxhash64(*by).alias("_h")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select("_h")
