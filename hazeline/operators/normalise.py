"""Keys, names, layouts, labels and model inputs of station tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions import layouts
from hazeline.functions.physics import clip
from hazeline.functions.quantiles import exact_quantiles


def canonical_name(name: Column) -> Column:
    """Upper case with _ for - and space; its alias, or that of it without _, or the trimmed name itself."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(layouts.NAMES.items())])
    upper = F.regexp_replace(F.upper(F.trim(name)), "[- ]", "_")
    return F.coalesce(F.element_at(table, upper), F.element_at(table, F.regexp_replace(upper, "_", "")), F.trim(name))


def station_key(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(name.cast("string")), r"\.0$", ""))


def numeric_station_key(name: Column) -> Column:
    """Numbers as integer text, other names trimmed."""
    number = name.try_cast("double")
    return F.coalesce(number.cast("bigint").cast("string"), F.trim(name.cast("string")))


def time_key(time: Column, shift_hours: int = 0) -> Column:
    """Text yyyy-MM-dd HH:mm:ss of a time or of its text, shifted; null where it can't be read."""
    read = F.coalesce(time.try_cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    return F.date_format(read + F.expr(f"interval {shift_hours} hours"), "yyyy-MM-dd HH:mm:ss")


def checked_time_key(df: DataFrame, time: str, out: str = "time_key", shift_hours: int = 0) -> DataFrame:
    """df with its time key; the result fails on a time that can't be read."""
    unread = F.raise_error(F.concat(F.lit(f"{time} can't be read: "), F.coalesce(F.col(time).cast("string"), F.lit("null"))))
    return df.withColumn(out, F.coalesce(time_key(F.col(time), shift_hours), unread.cast("string")))


def layout(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature_set, pos, name of named sets, as a table."""
    rows = [(s, i, x) for s in names for i, x in enumerate(layouts.feature_set(s))]
    return df.sparkSession.createDataFrame(rows, "feature_set string, pos int, name string")


def available_features(fields: DataFrame, by: str = "source", name: str = "variable") -> DataFrame:
    """by, features: the canonical slots that the fields of each group hold or give, in canonical order."""
    held = fields.groupBy(by).agg(F.collect_set(canonical_name(F.col(name))).alias("_held"))
    has = lambda xs: F.size(F.array_intersect("_held", F.array(*[F.lit(x) for x in xs]))) == len(xs)
    derived = F.filter(F.array(*[F.when(has(xs), F.lit(k)) for k, xs in layouts.DERIVED]), lambda x: x.isNotNull())
    order = F.array(*[F.lit(x) for x in layouts.ORDER])
    return held.select(by, F.array_intersect(order, F.array_union("_held", derived)).alias("features"))


def resolved_layouts(fields: DataFrame, names: Sequence[str], by: str = "source", name: str = "variable") -> DataFrame:
    """by, feature_set, pos, name, held: the columns of named sets for each group of fields, and whether the group
    holds or gives them; source_full is what it holds or gives."""
    sets = [(s, i, x) for s in names if layouts.set_name(s) != "source_full" for i, x in enumerate(layouts.feature_set(s))]
    fixed = F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(i).alias("pos"), F.lit(x).alias("name")) for s, i, x in sets])
    own = F.transform("features", lambda x, i: F.struct(F.lit("source_full").alias("feature_set"), i.cast("int").alias("pos"), x.alias("name")))
    rows = F.concat(fixed, own) if any(layouts.set_name(s) == "source_full" for s in names) else fixed
    out = available_features(fields, by, name).withColumn("r", F.explode(rows))
    return out.select(by, "r.*", F.array_contains("features", F.col("r.name")).alias("held"))


def scatter_fields(long: DataFrame, keys: Sequence[str], names: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Long (keys, variable, value) to one column for each of names; slots without a field are fill, of repeated ones the largest counts.

    One aggregation by keys: a pivot would count by keys and variable first, with a row for each field."""
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])
    return wide if fill is None else wide.fillna(fill, subset=list(names))


def select_layout(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*keys, *names)


def to_long(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(names), "variable", "value")


def in_metres(df: DataFrame, vis: str) -> DataFrame:
    """Visibility in metres: a table whose largest value is under 100 holds kilometres."""
    top = df.agg(F.max(vis).alias("_top"))  # one row
    scaled = F.when(F.col("_top") < 100, F.col(vis) * 1000.0).otherwise(F.col(vis))
    return df.crossJoin(F.broadcast(top)).withColumn(vis, scaled).drop("_top")


def label_qc(df: DataFrame, vis: str, ceiling: float = 30_000.0) -> DataFrame:
    return df.filter(F.col(vis).between(0, ceiling) & ~F.isnan(vis))


def label_violations(df: DataFrame, vis: str, ceiling: float = 30_000.0) -> DataFrame:
    v = F.col(vis)
    return df.agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_missing"), F.count_if(v < 0).alias("n_negative"),
        F.count_if(v > ceiling).alias("n_over"),
    )


#: Variables that enter a model by the logarithm of 1 + x (fixed values).
LOGGED = ("PRECIP", "SW_RAD", "CAPE", "PM10", "PM25")


def logged(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.log1p(clip(F.col(n), low=0.0)) for n in names})


def fit_robust_scaler(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, center (median), scale (P95 - P5) of each column."""
    return robust_scaler(df.unpivot([], list(names), "name", "value"))


def robust_scaler(long: DataFrame) -> DataFrame:
    """name, center, scale of long (name, value)."""
    found = exact_quantiles(long, ["name"], {"v": F.col("value")}, {"center": ("v", 0.5), "low": ("v", 0.05), "high": ("v", 0.95)})
    return found.select("name", "center", (F.col("high") - F.col("low")).alias("scale"))


def model_input(long: DataFrame, scaler: DataFrame) -> DataFrame:
    """long (..., name, value) with scaled: (value - center) / (scale + 1e-6) within 10; missing is 0."""
    z = (F.col("value") - F.col("center")) / (F.col("scale") + 1e-6)
    joined = long.join(F.broadcast(scaler), "name")  # a row a name
    return joined.withColumn("scaled", F.coalesce(clip(F.nanvl(z, F.lit(None).cast("double")), -10.0, 10.0), F.lit(0.0))).drop("center", "scale")


def pack_row(window: Column, names: Sequence[str], tail: Sequence[Column]) -> Column:
    """The flat row of an array of structs: steps in time order, each in the order of names, then tail."""
    steps = F.flatten(F.transform(window, lambda w: F.array(*[w[n].cast("double") for n in names])))
    return F.concat(steps, F.array(*[t.cast("double") for t in tail]))


def unpack_row(df: DataFrame, flat: str, keys: Sequence[str], names: Sequence[str], steps: int = 12) -> DataFrame:
    """keys, name, lag (-steps + 1 to 0), value of the window part of a flat row."""
    width = len(names)
    part = df.select(*keys, F.posexplode(F.slice(flat, 1, width * steps)).alias("_at", "value"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_at") % width)
    return part.select(*keys, name.alias("name"), (F.floor(F.col("_at") / width) - (steps - 1)).cast("int").alias("lag"), "value")


def station_filter(df: DataFrame, lat: str = "lat", lon: str = "lon", key: str | None = "station_id") -> DataFrame:
    """Stations in 10-60 N, 65-145 E with finite coordinates; the result fails where a key repeats among them."""
    kept = df.filter(F.col(lat).between(10, 60) & F.col(lon).between(65, 145))
    if key is None:
        return kept
    columns = [F.first(c).alias(c) for c in kept.columns if c != key]
    once = kept.groupBy(key).agg(*columns, F.count("*").alias("_n"))
    repeats = F.raise_error(F.concat(F.lit("station repeats: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    kind = dict(kept.dtypes)[key]
    checked = once.withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(repeats.cast(kind)))
    return checked.select(*kept.columns)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
