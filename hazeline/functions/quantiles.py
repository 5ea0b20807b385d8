"""Exact quantiles of groups of any size, by two passes that combine before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch knows ranks to 1 / ACCURACY of its rows. Brackets hold all rows of groups of fewer than FEW rows.
ACCURACY, FEW = 10_000, 10_000
#: A sketch grows with each that is merged into it, so that merging takes the square of their number. A group's are merged in BUCKETS
#: parts; each gives POINTS values at even ranks, a part of few rows about one a row.
BUCKETS, POINTS = 32, 2_000


def exact_quantiles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by and one column for each of wanted: the quantile of one of values, interpolated between ranks; null without a value.

    Mergeable sketches bracket each quantile: of the values that a group's sketches give, the last that is surely below it and the
    first that surely isn't, by their running counts and the greatest error of these. The second pass counts rows by value inside the
    brackets and as one sum between them, so that running counts give the exact ranks; it keeps some thousandths of the
    distinct values of a group, and their window may spill. Brackets and quantiles, a row a group and much smaller than its sketch, are broadcast: a
    join by few groups would have a task a group.
    """
    keys, names = [f"_k{i}" for i in range(len(by))], list(values)
    points = sorted({p for _, p in wanted.values()})
    cells = F.array(*[F.struct(F.lit(i).alias("_e"), values[v].cast("double").alias("_x")) for i, v in enumerate(names)])
    held = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], cells.alias("_v"))
    long = held.select(*keys, F.explode("_v").alias("_v")) if len(names) > 1 else held.select(*keys, F.get("_v", F.lit(0)).alias("_v"))
    long = long.select(*keys, "_v._e", "_v._x")

    even = F.expr(f"array({','.join(f'{i / POINTS}D' for i in range(1, POINTS + 1))})")
    parts = long.withColumn("_s", F.spark_partition_id() % BUCKETS).groupBy(*keys, "_e", "_s").agg(F.count("_x").alias("_m"), F.percentile_approx("_x", even, ACCURACY).alias("_b"))
    parts = parts.withColumn("_every", F.ceil(F.lit(POINTS) / F.greatest("_m", F.lit(1))))
    thinned = parts.withColumn("_b", F.filter("_b", lambda _, i: (i + 1) % F.col("_every") == 0))
    group = Window.partitionBy(*keys, "_e")
    sized = thinned.withColumn("_n", F.sum("_m").over(group))
    marks = sized.select(*keys, "_e", "_n", (F.col("_m") * F.col("_every")).alias("_w"), F.explode_outer(F.when(F.col("_n") >= FEW, F.col("_b"))).alias("_b"))
    marks = marks.withColumn("_to", F.sum(F.when(F.col("_b").isNotNull(), F.col("_w"))).over(group.orderBy("_b")))  # rows, times POINTS
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    error = F.col("_n") * (1 / POINTS + 1 / ACCURACY) + 6 * BUCKETS
    edges = [
        e for i, p in enumerate(points) for e in (
            F.coalesce(F.max(F.when(F.col("_to") <= (F.floor(rank(p)) - error) * POINTS, F.col("_b"))), F.lit(float("-inf"))).alias(f"_b{2 * i}"),
            F.coalesce(F.min(F.when(F.col("_to") >= (F.ceil(rank(p)) + error) * POINTS, F.col("_b"))), F.lit(float("inf"))).alias(f"_b{2 * i + 1}"),
        )
    ]
    per = marks.groupBy(*keys, "_e", "_n").agg(*edges)
    bounds = per.withColumnsRenamed({k: f"_g{k}" for k in keys} | {"_e": "_ge"})
    same = F.col("_e") == F.col("_ge")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g{k}"))

    x, place = F.col("_x"), F.when(F.col("_x") < F.col("_b0"), F.lit(float("-inf")))
    for i in range(len(points)):
        low, high = F.col(f"_b{2 * i}"), F.col(f"_b{2 * i + 1}")
        if i:
            place = place.when(x < low, F.col(f"_b{2 * i - 1}"))
        place = place.when(x <= high, x)
    place = place.otherwise(F.col(f"_b{2 * len(points) - 1}"))
    counts = long.filter(x.isNotNull()).join(F.broadcast(bounds), same).groupBy(*keys, "_e", place.alias("_p")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    counts = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_e").orderBy("_p")))

    reach = lambda r: F.min(F.when(F.col("_to") > r, F.col("_p")))
    found = counts.groupBy(*keys, "_e").agg(
        F.max("_n").alias("_n"),
        *[reach(F.floor(rank(p))).alias(f"_lo{i}") for i, p in enumerate(points)], *[reach(F.ceil(rank(p))).alias(f"_hi{i}") for i, p in enumerate(points)],
    )

    def value(i: int, p: float) -> Column:
        low, high, r = F.col(f"_lo{i}"), F.col(f"_hi{i}"), rank(p)
        return F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)

    found = found.select(*keys, "_e", *[value(i, p).alias(f"_q{i}") for i, p in enumerate(points)])
    found = found.unionByName(per.select(*keys, "_e"), allowMissingColumns=True)  # groups without a value
    pick = lambda v, p: F.max(F.when(F.col("_e") == names.index(v), F.col(f"_q{points.index(p)}")))
    out = found.groupBy(*keys).agg(*[pick(v, p).alias(name) for name, (v, p) in wanted.items()])
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *wanted)


def with_quantiles(summary: DataFrame, df: DataFrame, by: Sequence[str], values: Mapping[str, Column], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """summary, a row a group of df, with its quantiles."""
    found = exact_quantiles(df, by, values, wanted)
    if not by:
        return summary.crossJoin(found)  # one row each
    found = found.withColumnsRenamed({b: f"_of_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    return summary.join(F.broadcast(found), same).drop(*[f"_of_{b}" for b in by])
