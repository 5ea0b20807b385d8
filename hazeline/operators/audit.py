"""Audits: quality scans, shared-covariate and protocol checks, product comparisons; issues as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.quantiles import with_quantiles
from hazeline.operators.splits import even_sample

ISSUE = "stage string, severity string, message string"


def feature_quality_scan(long: DataFrame, bounds: DataFrame, by: Sequence[str] = ("source", "split", "feature")) -> DataFrame:
    """Per group of long (by, value): values, finite, non-zero and outside-bounds fractions, mean, min, max.

    bounds: feature, low, high; a feature without bounds is never outside.
    """
    x = F.col("value")
    share = lambda c: F.count_if(c) / F.count("*")
    joined = long.join(bounds, "feature", "left")
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"), share(x.isNotNull()).alias("finite_fraction"), share(F.abs(x) > 1e-12).alias("nonzero_fraction"),
        share((x < F.col("low")) | (x > F.col("high"))).alias("outside_fraction"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
    )


def quality_issues(scan: DataFrame, by: Sequence[str] = ("source", "split", "feature")) -> DataFrame:
    """by, issue: every fault of each group."""
    faults = F.array(
        F.when(F.col("finite_fraction") < 0.99, "not finite"), F.when(F.col("nonzero_fraction") <= 1e-6, "all zero"),
        F.when(F.col("outside_fraction") > 0.01, "outside bounds"),
    )
    return scan.select(*by, F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("issue"))


def valid_time_scope(df: DataFrame, time: Column, year: int, spill_days: int, by: Sequence[str]) -> DataFrame:
    """Per group: rows in the year, in the days after it that are allowed, and outside both."""
    days = F.datediff(time, F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))
    inside = F.year(time) == year
    spill = (days >= 0) & (days < spill_days)
    return df.groupBy(*by).agg(F.count_if(inside).alias("n_year"), F.count_if(spill).alias("n_spill"), F.count_if(~inside & ~spill).alias("n_outside"))


def label_agreement(df: DataFrame, reference: str, key: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """source, n, n_vis_mismatch, n_cls_mismatch against the reference source on paired rows."""
    ref = df.filter(F.col("source") == reference).select(*key, F.col("vis_m").alias("_v"), F.col("y_cls").alias("_y"))
    both = df.filter(F.col("source") != reference).join(ref, list(key))
    return both.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("vis_m") - F.col("_v")) > tolerance).alias("n_vis_mismatch"), F.count_if(F.col("y_cls") != F.col("_y")).alias("n_cls_mismatch")
    )


def _paired_columns(left: DataFrame, right: DataFrame, key: Sequence[str], names: Sequence[str], name: str) -> DataFrame:
    """name, a, b for each column of the rows that both sides have: joined once by key, unpivoted after it."""
    theirs = right.select(*key, *[F.col(n).alias(f"_{n}") for n in names])
    both = left.select(*key, *names).join(theirs, list(key))
    pair = lambda n: F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias("a"), F.col(f"_{n}").cast("double").alias("b"))
    return both.select(F.inline(F.array(*[pair(n) for n in names])))


def shared_covariate_diff(left: DataFrame, right: DataFrame, key: Sequence[str], names: Sequence[str], atol: float = 1e-4, rtol: float = 1e-5) -> DataFrame:
    """name, n, n_bad (|a - b| > atol + rtol |b|), max_diff, mean_diff, mean_left, mean_right of paired columns."""
    both = _paired_columns(left, right, key, names, "name")
    d = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(d > F.abs(F.col("b")) * rtol + atol).alias("n_bad"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"),
        F.avg("a").alias("mean_left"), F.avg("b").alias("mean_right"),
    )


def covariate_groups(diff: DataFrame, group: Column) -> DataFrame:
    return diff.groupBy(group.alias("grp")).agg(F.count("*").alias("n_columns"), F.sum("n_bad").alias("n_bad"), F.max("max_diff").alias("max_diff"))


def protocol_equality(configs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n_values, found for the fields in which the configurations (a row a dataset) differ."""
    long = configs.select("dataset", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")).select("dataset", "c.*")
    known = F.coalesce("value", F.lit("missing"))
    per = long.groupBy("field").agg(F.count_distinct(known).alias("n_values"), F.array_join(F.array_sort(F.collect_set(known)), "|").alias("found"))
    return per.filter(F.col("n_values") > 1)


#: Range of the mean of a variable in canonical units (fixed values).
MEAN_RANGES = {"MSLP": (5e4, 1.2e5), "Q_1000": (1e-5, 0.04), "Q_925": (1e-5, 0.04)}


def cross_source_units(scan: DataFrame, expected: DataFrame, by: Sequence[str] = ("source", "split")) -> DataFrame:
    """by, feature, issue: groups of expected (by, feature) that scan lacks or whose mean is out of range."""
    ok = reduce(lambda a, b: a | b, [(F.col("feature") == f) & (F.col("mean") > lo) & (F.col("mean") < hi) for f, (lo, hi) in MEAN_RANGES.items()])
    keys = [*by, "feature"]
    both = expected.join(scan.select(*keys, "mean"), keys, "left").filter(F.col("feature").isin(*MEAN_RANGES))
    issue = F.when(F.col("mean").isNull(), "missing").when(~ok, "mean out of range")
    return both.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(*keys, "issue")


#: A derived field and the native fields that its conversion needs.
NEEDS = (
    ("RH2M", ("T2M", "D2M")), ("Q_1000", ("T_1000", "RH_1000")), ("Q_925", ("T_925", "RH_925")), ("DP_1000", ("Q_1000",)), ("DP_925", ("Q_925",)),
    ("WSPD10", ("U10", "V10")), ("WDIR10", ("U10", "V10")), ("WSPD925", ("U_925", "V_925")), ("INVERSION", ("T_925", "T2M")),
)


def lineage_rules(configs: DataFrame, policy: str, order: Sequence[str] | None = None, units: dict[str, str] | None = None, step: float | None = 1.0) -> DataFrame:
    """dataset, issue of configurations with arrays native, derived, zero_filled and texts unit_policy, time_zone.

    A field can't be both native and derived; a derived one needs the native or derived fields of its conversion; both
    relative humidities need their temperature; none may be zero-filled; policy and UTC must be said. With order, the array
    feature_order must equal it; with units, the map must hold them; with step, time_step must equal it, where configs has
    these columns."""
    both = F.array_intersect("native", "derived")
    held = F.concat("native", "derived")
    has = lambda x: F.array_contains(held, x)
    lacks = lambda xs: ~F.array_contains(F.transform(F.array(*[F.lit(x) for x in xs]), lambda x: F.array_contains(held, x)), False)
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    faults = [
        F.when(F.size(both) > 0, F.concat(F.lit("native and derived: "), listed(both))),
        F.when(F.size("zero_filled") > 0, F.concat(F.lit("zero-filled: "), listed("zero_filled"))),
        F.when(has("RH_925") & ~has("T_925"), "RH_925 without T_925"),
        F.when(has("RH_1000") & ~has("T_1000"), "RH_1000 without T_1000"),
        *[F.when(F.array_contains("derived", k) & ~lacks(xs), f"{k} derived without {','.join(xs)}") for k, xs in NEEDS],
        F.when(~F.col("unit_policy").eqNullSafe(F.lit(policy)), "unit policy differs"), F.when(~F.col("time_zone").eqNullSafe(F.lit("UTC")), "time isn't UTC"),
    ]
    if order is not None and "feature_order" in configs.columns:
        faults.append(F.when(~F.col("feature_order").eqNullSafe(F.array(*[F.lit(x) for x in order])), "feature order differs"))
    if units is not None and "units" in configs.columns:
        faults += [F.when(~F.col("units").getItem(k).eqNullSafe(F.lit(u)), f"unit of {k} isn't {u}") for k, u in units.items()]
    if step is not None and "time_step" in configs.columns:
        faults.append(F.when(~F.coalesce(F.abs(F.col("time_step") - step) <= 1e-6, F.lit(False)), "time step differs"))
    return configs.select("dataset", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("issue"))


def changed_stations(old: DataFrame, new: DataFrame, key: str = "station_id", tolerance: float = 1e-6) -> DataFrame:
    """The stations of both products whose coordinates differ."""
    n = new.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    moved = (F.abs(F.col("lat") - F.col("_lat")) > tolerance) | (F.abs(F.col("lon") - F.col("_lon")) > tolerance)
    return old.select(key, "lat", "lon").join(n, key).filter(moved).select(key).distinct()


def common_times(old: DataFrame, new: DataFrame, time: str, n: int) -> DataFrame:
    """n evenly spaced ones of the times that both products have."""
    return even_sample(old.select(time).distinct().join(new.select(time).distinct(), time), time, n)


def product_diff(old: DataFrame, new: DataFrame, key: Sequence[str], names: Sequence[str], only: Sequence[DataFrame] = ()) -> DataFrame:
    """variable, n, n_changed (> 1e-7), max_diff, mean_diff of the cells that both products hold; of the rows in each of the
    tables of only (common_times, changed_stations), where given."""
    for rows in only:
        old = old.join(rows, list(rows.columns), "left_semi")
    both = _paired_columns(old, new, key, names, "variable").filter("a is not null and b is not null")
    d = F.abs(F.col("b") - F.col("a"))
    return both.groupBy("variable").agg(F.count("*").alias("n"), F.count_if(d > 1e-7).alias("n_changed"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def feature_shift(long: DataFrame, scaler: DataFrame, by: Sequence[str] = ("population", "name")) -> DataFrame:
    """Per group of long (population, name, value): finite and zero rates, quantiles raw and scaled, rates of |z| over 3 and 8."""
    x = F.col("value")
    z = (x - F.col("center")) / (F.col("scale") + 1e-6)
    rate = lambda c: F.count_if(c) / F.count("*")
    points = (1, 5, 50, 95, 99)
    joined = long.join(F.broadcast(scaler), "name")  # a row a name
    out = joined.groupBy(*by).agg(
        F.count("*").alias("n"), rate(x.isNotNull()).alias("finite_rate"), rate(x == 0).alias("zero_rate"),
        rate(F.abs(z) > 3).alias("rate_3"), rate(F.abs(z) > 8).alias("rate_8"),
    )
    return with_quantiles(out, joined, by, {"p": x, "z": z}, {f"{v}{p}": (v, p / 100) for v in "pz" for p in points})


def dedupe_sources(runs: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """One row a source, of its last run_dir, with its place: preferred sources first, in their order, then by name."""
    last = runs.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("run_dir")))).filter("_r = 1").drop("_r")
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("source"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), "source")  # one row a source
    return last.withColumn("place", F.row_number().over(order).cast("long"))


def staged_audit(stages: Sequence[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """All issues (severity, message) of the stages up to the first that has an error, as stage, severity, message.

    Stages are functions, in the order of their cost: later ones aren't run after a failure.
    """
    found = None
    for name, make in stages:
        issues = make().select(F.lit(name).alias("stage"), "severity", "message")
        found = issues if found is None else found.union(issues)
        if issues.filter("severity = 'error'").limit(1).count():
            break
    if found is None:
        raise ValueError("no stage is given")
    return found


def file_time_check(files: DataFrame, step: int = 1) -> DataFrame:
    """One row over files (path, init_h, h): times in several files, irregular steps of their union, and rows whose lead in
    the file name (lead<n>h) isn't valid - init."""
    named = F.regexp_extract("path", r"lead(\d+)h", 1).try_cast("long")
    rows = files.withColumn("_bad", F.coalesce(named != F.col("h") - F.col("init_h"), F.lit(True)))
    per = rows.groupBy("h").agg(F.count_distinct("path").alias("_p"), F.count_if("_bad").alias("_b"))
    delta = F.col("h") - F.lag("h").over(Window.orderBy("h"))  # one row a time of the axis
    return per.withColumn("_d", delta).agg(
        F.count_if(F.col("_p") > 1).alias("n_repeated"), F.count_if(F.col("_d") != step).alias("n_irregular"), F.sum("_b").alias("n_lead_mismatch")
    )
