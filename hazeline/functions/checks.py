"""Checks that are part of a plan: a result that breaks one fails when it is evaluated, without an action before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failing(out: DataFrame, faults: DataFrame, message: Column | str) -> DataFrame:
    """out; its evaluation fails with message (which may name columns of faults) where faults has a row."""
    text = F.lit(message) if isinstance(message, str) else message
    raised = faults.select(F.raise_error(F.coalesce(text, F.lit("check failed"))).cast("boolean").alias("_raised")).filter("_raised")
    return out.unionByName(raised.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields]))


def described(*parts: Column | str) -> Column:
    """Texts and columns as one text; null columns are written as null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df; its evaluation fails where a key is in more than one row. The count is made on the shuffle by key that gives the
    result, so df is read once."""
    n = unused_name(df, "n")
    counted = df.withColumn(n, F.count("*").over(Window.partitionBy(*keys)))
    repeats = F.raise_error(described("key occurs ", F.col(n), " times: ", *[x for k in keys for x in (F.col(k), " ")])).cast("boolean")
    return counted.filter(F.when(F.col(n) > 1, repeats).otherwise(True)).drop(n)


def unused_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
