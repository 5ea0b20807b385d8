"""Texts of digits and hyphens at half their size, for rows that are shuffled or stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(text: Column) -> Column:
    """text as (digits, text), one of them null: two characters a byte where it has only digits and hyphens, else itself. Equal texts are
    packed alike, others not; the order of texts isn't kept."""
    plain = F.translate(text, "0123456789-", "") == ""
    nibbles = F.concat(F.translate(text, "-", "A"), F.when(F.length(text) % 2 == 1, "F").otherwise(""))
    return F.struct(F.when(plain, F.unhex(nibbles)).alias("digits"), F.when(~plain, text).alias("text"))


def unpacked(pair: Column) -> Column:
    return F.coalesce(F.translate(F.rtrim(F.hex(pair["digits"]), F.lit("F")), "A", "-"), pair["text"])


def pack(df: DataFrame, names: list[str]) -> DataFrame:
    """df with those of names packed that are strings."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: packed(F.col(n)) for n in names if kinds[n] == "string"})


def unpack(df: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    """pack undone, for names that are strings in like."""
    kinds = dict(like.dtypes)
    return df.withColumns({n: unpacked(F.col(n)) for n in names if kinds[n] == "string"})
