"""Unit policy and quality control: statistics of a group of values decide how the group is scaled.

A group is given by columns (a source and variable), never by chunks of rows, so results don't depend on
partitioning. Quantiles are exact and computed without a task that holds a group; they are joined back by an
equi-join on the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.physics import clip, dewpoint_from_q
from hazeline.functions.quantiles import exact_quantiles, with_quantiles

TEMPERATURES = ("T2M", "D2M", "T_925", "T_1000", "DP_925", "DP_1000")
HUMIDITIES = ("RH2M", "RH_925", "RH_1000")
SPECIFIC = ("Q_925", "Q_1000")
PM_MOST = 10_000.0
LEGACY = "legacy_kgm3_times_1e12"


def _with_quantile(df: DataFrame, group: Sequence[str], value: Column, point: float, name: str) -> DataFrame:
    """df with the quantile of value over its group."""
    return df.join(F.broadcast(exact_quantiles(df, group, {"x": value}, {name: ("x", point)})), list(group))


def canonicalize_units(df: DataFrame, group: Sequence[str] = ("source", "variable"), check: bool = True) -> DataFrame:
    """df (..., variable, value) with pressure in Pa, temperature in K, humidity in % and kg/kg.

    The median of |value| of a group decides; with check, the result fails on a pressure group of neither hPa nor Pa.
    """
    df = _with_quantile(df, group, F.abs(F.col("value")), 0.5, "_m")
    name, x, m = F.col("variable"), F.col("value"), F.col("_m")
    unknown = (name == "MSLP") & ~m.between(500, 2000) & ~m.between(20_000, 120_000) if check else F.lit(False)
    value = (
        F.when(unknown, F.raise_error(F.concat(F.lit("pressure is neither hPa nor Pa; its median is "), m.cast("string"))).cast("double"))
        .when((name == "MSLP") & m.between(500, 2000), x * 100.0)
        .when(name.isin(*TEMPERATURES) & (m < 150), x + 273.15)
        .when(name.isin(*HUMIDITIES) & (m <= 1.5), x * 100.0)
        .when(name.isin(*SPECIFIC) & (m > 0.2), x / 1000.0)
        .otherwise(x)
    )
    return df.withColumn("value", value).drop("_m")


def canonicalize_pm(df: DataFrame, value: str, declared: str, group: Sequence[str]) -> DataFrame:
    """Concentrations in ug m-3: negatives are missing; the declared unit and the median of positives decide."""
    x = F.when(F.col(value) >= 0, F.col(value))
    df = _with_quantile(df.withColumn(value, x), group, F.when(F.col(value) > 0, F.col(value)), 0.5, "_m")
    unit, m = F.lower(F.coalesce(F.col(declared), F.lit(""))), F.col("_m")
    factor = (
        F.when(unit == LEGACY, 1e-3).when(m.isNull(), 1.0).when(m < 1e-3, 1e9).when(m > 1e4, 1e-3).when(unit.startswith("kg"), 1e9).otherwise(1.0)
    )
    return df.withColumn(value, F.col(value) * factor).drop("_m")


def sanitize_pm(df: DataFrame, value: str, declared: str, group: Sequence[str], fill: float | None = None) -> DataFrame:
    """canonicalize_pm, then values that are missing or outside [0, 10000] become fill, or the median of the
    group's valid values, or 0."""
    if fill is not None and not 0 <= fill <= PM_MOST:
        raise ValueError(f"fill {fill} is outside [0, {PM_MOST}]")
    df = canonicalize_pm(df, value, declared, group)
    valid = F.when(F.col(value).between(0, PM_MOST), F.col(value))
    if fill is not None:
        return df.withColumn(value, F.coalesce(valid, F.lit(float(fill))))
    df = _with_quantile(df.withColumn(value, valid), group, F.col(value), 0.5, "_m")
    return df.withColumn(value, F.coalesce(F.col(value), F.col("_m"), F.lit(0.0))).drop("_m")


def normalize_rh(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Percent within 0 to 100; a group whose P99 is 2 at most holds fractions."""
    df = _with_quantile(df, group, F.col(value), 0.99, "_p")
    return df.withColumn(value, clip(F.when(F.col("_p") <= 2, F.col(value) * 100.0).otherwise(F.col(value)), 0.0, 100.0)).drop("_p")


def q_to_gkg(df: DataFrame, value: str, declared: str, group: Sequence[str]) -> DataFrame:
    """g/kg by the declared unit, or by P99 of |value| where none is; with provenance."""
    df = _with_quantile(df, group, F.abs(F.col(value)), 0.99, "_p")
    unit = F.lower(F.trim(F.coalesce(F.col(declared), F.lit(""))))
    known = F.when(unit.isin("kg kg-1", "kg/kg", "1"), "declared kg/kg").when(unit.isin("g kg-1", "g/kg"), "declared g/kg")
    origin = F.coalesce(known, F.when(F.col("_p") < 0.2, "inferred kg/kg").otherwise("inferred g/kg"))
    df = df.withColumn("provenance", origin)
    return df.withColumn(value, F.when(F.col("provenance").endswith("kg/kg") & ~F.col("provenance").endswith(" g/kg"), F.col(value) * 1000.0).otherwise(F.col(value))).drop("_p")


def train_only_fill(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """One row: fill (centre of the histogram bin of width 1 that holds the median of valid train values; 0 if
    there is none), n_total, n_invalid. Counts by bin are at most 10,000 rows."""
    train = df.filter(F.col(split) == "train")
    ok = F.coalesce(F.col(value).between(0, PM_MOST), F.lit(False))
    totals = train.agg(F.count("*").alias("n_total"), F.count_if(~ok).alias("n_invalid"))
    bins = train.filter(ok).groupBy(F.least(F.floor(value), F.lit(int(PM_MOST) - 1)).alias("bin")).agg(F.count("*").alias("c"))
    along = Window.orderBy("bin")
    bins = bins.withColumns({"upto": F.sum("c").over(along), "all": F.sum("c").over(Window.partitionBy())})
    rank = F.floor((F.col("all") - 1) / 2) + 1
    fill = bins.filter(F.col("upto") >= rank).agg((F.min("bin") + 0.5).alias("fill"))
    return totals.crossJoin(F.broadcast(fill)).select(F.coalesce("fill", F.lit(0.0)).alias("fill"), "n_total", "n_invalid")  # one row each


def physical_range_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    x = F.col(value)
    points = {"p0_1": 0.001, "p1": 0.01, "p99": 0.99, "p99_9": 0.999}
    outside = lambda c: F.count_if(c) / F.count(x)
    out = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x < 0).alias("n_negative"), F.count_if(x < -0.01).alias("n_under"), F.count_if(x > 40).alias("n_over_40"),
        F.count_if(x > 80).alias("n_over_80"), outside((x < -0.01) | (x > 40)).alias("outside_fraction"),
    )
    return with_quantiles(out, df, by, {"x": x}, {name: ("x", p) for name, p in points.items()})


def encoding_stats(df: DataFrame, value: str, factor: float, by: Sequence[str], time: str | None = None) -> DataFrame:
    """Counts, quantiles q0 to q6 (0, 0.1, 1, 50, 99, 99.9 and 100 %), rates of negatives and of values outside the bounds in
    ug m-3, and the first and last time where one is given."""
    x = F.col(value)
    points = (0.0, 0.001, 0.01, 0.5, 0.99, 0.999, 1.0)
    share = lambda c: F.count_if(c) / F.count("*")
    ends = [F.min(time).alias("time_min"), F.max(time).alias("time_max")] if time else []
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count(x) / F.count("*")).alias("finite_fraction"),
        share(x < 0).alias("negative_fraction"), share((x * factor < 0) | (x * factor > PM_MOST)).alias("outside_fraction"), *ends,
    )
    return with_quantiles(out, df, by, {"x": x}, {f"q{i}": ("x", p) for i, p in enumerate(points)})


def dewpoint_consistency(df: DataFrame, dew_point: str, q: str, p_hpa: float, by: Sequence[str]) -> DataFrame:
    """Mean |given - derived| dew point by group."""
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(dew_point) - dewpoint_from_q(F.col(q), p_hpa))).alias("mae"))
