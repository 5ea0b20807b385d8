"""Hourly station series: windows, time axes, leads and fog features.

All windows of a station share one partitioning and order, so a feature table is one shuffle and one sort; counts, sums and
extremes of the last 12 rows are aggregates of one frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.checks import described, failing
from hazeline.functions.physics import clip, sigmoid
from hazeline.functions.quantiles import exact_quantiles

STEPS = 12


def along(station: str = "station_id", time: str = "h"):
    return Window.partitionBy(station).orderBy(time)


def sliding_window(df: DataFrame, names: Sequence[str], n: int = STEPS, step: int = 1, station: str = "station_id", time: str = "h") -> DataFrame:
    """df with win, the last n hours as an array of structs, where all n are there and follow each other hourly.

    With a step, of the complete rows of a station the first and every step-th after it by position."""
    w = along(station, time)
    last = w.rowsBetween(-(n - 1), 0)
    win = F.collect_list(F.struct(*[F.col(c) for c in names])).over(last)
    df = df.withColumns({"win": win, "_first": F.lag(time, n - 1).over(w), "_row": F.row_number().over(w)})
    whole = (F.size("win") == n) & (F.col(time) - F.col("_first") == n - 1)
    return df.filter(whole & (F.pmod(F.col("_row") - n, F.lit(step)) == 0)).drop("_first", "_row")


#: Rows back that window_stats and acceleration look at.
BACK = (3, 6)


def with_last(df: DataFrame, names: Sequence[str], n: int = STEPS, station: str = "station_id", time: str = "h", out: str = "_last") -> DataFrame:
    """df with what window_stats needs: for each name its values 3 and 6 rows before, and over the last n rows of the station the
    number of values, the least, the greatest, and the sums of their distances to the station's first value and of the squares of
    these (exact for short decimals, 0 for a constant).

    All share one partitioning and order, and all sums of a row are updated together."""
    w = along(station, time)
    df = df.withColumns({f"{out}_away_{c}": F.col(c) - F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in names})
    last = w.rowsBetween(-(n - 1), 0)
    cols: dict[str, Column] = {}
    for c in names:
        x, away = F.col(c), F.col(f"{out}_away_{c}")
        cols |= {f"{out}_{k}_{c}": F.lag(c, k).over(w) for k in BACK}
        cols |= {f"{out}_n_{c}": F.count(x).over(last), f"{out}_low_{c}": F.min(x).over(last), f"{out}_high_{c}": F.max(x).over(last)}
        cols |= {f"{out}_sum_{c}": F.sum(away).over(last), f"{out}_square_{c}": F.sum(away * away).over(last)}
    return df.withColumns(cols)


def before(name: str, k: int, last: str = "_last") -> Column:
    """The value k rows before, k one of BACK; null where there is none."""
    return F.col(f"{last}_{k}_{name}")


def window_stats(name: str, last: str = "_last") -> dict[str, Column]:
    """Change over 3 and 6 steps, population spread and range of a column over the rows of with_last."""
    x, n = F.col(name), F.nullif(F.col(f"{last}_n_{name}"), F.lit(0))  # null without a value
    total, square = F.col(f"{last}_sum_{name}"), F.col(f"{last}_square_{name}")
    spread = F.sqrt(F.greatest(n * square - total * total, F.lit(0.0))) / n
    return {
        f"{name}_d3": x - before(name, 3, last), f"{name}_d6": x - before(name, 6, last), f"{name}_std": F.when(square.isNotNull(), spread),
        f"{name}_range": F.col(f"{last}_high_{name}") - F.col(f"{last}_low_{name}"),
    }


def acceleration(name: str, last: str = "_last") -> Column:
    return (F.col(name) - before(name, 3, last)) - (before(name, 3, last) - before(name, 6, last))


def time_axis_steps(df: DataFrame, time: str = "h", by: Sequence[str] = ()) -> DataFrame:
    """The distinct times of each group with delta, the step from the one before."""
    axis = df.select(*by, time).distinct()
    return axis.withColumn("delta", F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time)))


def time_axis_summary(df: DataFrame, time: str = "h", step: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Per group: times, start, end, least and largest step, irregular steps, histogram of steps as a map."""
    steps = time_axis_steps(df, time, by)
    per = steps.groupBy(*by, "delta").agg(F.count("*").alias("_c"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("delta", "_c"))))
    return per.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.min("_lo").alias("start"), F.max("_hi").alias("end"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
        F.coalesce(F.sum(F.when(F.col("delta") != step, F.col("_c"))), F.lit(0)).alias("n_irregular"), F.map_from_entries(pairs).alias("deltas"),
    )


def require_regular(df: DataFrame, time: str = "h", step: int = 1) -> DataFrame:
    """df; fails on a null time, or a step of the axis other than step."""
    kind = dict(df.dtypes)[time]
    known = df.withColumn(time, F.coalesce(time, F.raise_error("a time is null").cast(kind)))
    odd = time_axis_steps(df, time).filter(F.col("delta") != step)
    return failing(known, odd, described("the axis steps by ", F.col("delta"), " to ", F.col(time)))


def segment_cadence(df: DataFrame, by: Sequence[str], time: str = "minute", unit: int = 60) -> DataFrame:
    """Per segment: times, those off the unit, steps of one unit, steps that aren't whole units."""
    steps = time_axis_steps(df, time, by)
    return steps.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.pmod(F.col(time), F.lit(unit)) != 0).alias("n_off"), F.count_if(F.col("delta") == unit).alias("n_unit"),
        F.count_if(F.pmod(F.col("delta"), F.lit(unit)) != 0).alias("n_broken"),
    )


def lead_evidence(df: DataFrame, valid: str, init: str | None, declared: str | None, stitched: bool = False) -> DataFrame:
    """lead and provenance of each row: valid - init (which must agree with a declared lead), else the declared lead, else
    optionally the lead of stitched runs. disagrees marks rows where both exist and differ."""
    none = F.lit(None).cast("double")
    made = (F.col(valid) - F.col(init)).cast("double") if init else none
    said = F.col(declared).cast("double") if declared else none
    of_day = F.pmod(F.col(valid), F.lit(24))
    guess = F.when(of_day < 12, of_day + 12).otherwise(of_day).cast("double") if stitched else none
    origin = F.when(made.isNotNull(), "valid minus init").when(said.isNotNull(), "declared").when(guess.isNotNull(), "stitched runs").otherwise("none")
    differs = F.coalesce(F.abs(made - said) > 1e-6, F.lit(False))
    return df.withColumns({"lead": F.coalesce(made, said, guess), "provenance": origin, "disagrees": differs})


def lead_summary(leads: DataFrame, by: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """by, provenance, n, lead_min, lead_max, n_disagree and leads, the rows by lead (6 digits) as a map; leads: lead_evidence's
    result. With low and high, fails where a group's leads don't range from one to the other."""
    per = leads.groupBy(*by, "provenance", F.round("lead", 6).alias("lead")).agg(F.count("*").alias("n"), F.count_if("disagrees").alias("d"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("lead").isNotNull(), F.struct("lead", "n")))))
    out = per.groupBy(*by, "provenance").agg(
        F.sum("n").alias("n"), F.min("lead").alias("lead_min"), F.max("lead").alias("lead_max"), F.sum("d").alias("n_disagree"), counts.alias("leads")
    )
    if low is None and high is None:
        return out
    near = lambda c, x: F.lit(True) if x is None else F.coalesce(F.abs(F.col(c) - x) <= 1e-6, F.lit(False))
    wrong = F.raise_error(described("leads range from ", F.col("lead_min"), " to ", F.col("lead_max"))).cast("boolean")
    return out.filter(F.when(near("lead_min", low) & near("lead_max", high), True).otherwise(wrong))


#: Weights of the fog potential's terms (fixed values).
FOG_WEIGHTS = {"rh": 0.40, "dpd": 0.25, "dpd_alone": 0.45, "wind": 0.20, "stability": 0.15, "night": 0.15}


def _helpers(df: DataFrame) -> dict[str, Column]:
    """The terms whose inputs df has; temperatures are in K."""
    c, have = F.col, set(df.columns)
    out: dict[str, Column] = {}

    def add(name: str, needs: str, make) -> None:
        if set(needs.split()) <= have:
            out[name] = make()

    add("rh", "RH2M", lambda: clip(c("RH2M") / 100.0, 0.0, 1.0))
    add("rh925", "RH_925", lambda: clip(c("RH_925") / 100.0, 0.0, 1.0))
    add("dpd", "DPD", lambda: F.lit(1.0) / (F.exp(c("DPD") / 2.0) + 1.0))
    add("wind", "WSPD10", lambda: F.exp(F.pow((c("WSPD10") - 3.5) / 2.5, 2.0) * -0.5))
    add("stability", "INVERSION WSPD10", lambda: F.tanh(c("INVERSION") / (c("WSPD10") * c("WSPD10") + 0.1) / 2.0))
    add("night", "ZENITH", lambda: F.when(c("ZENITH") > 90, 1.0).when(c("ZENITH").isNotNull(), 0.0))
    add("clear", "LCC", lambda: clip(F.lit(1.0) - c("LCC") / 0.3, 0.0, 1.0))
    add("dim", "SW_RAD", lambda: F.lit(1.0) - clip(clip(c("SW_RAD"), low=0.0) / 800.0, 0.0, 1.0))
    add("t_c", "T2M", lambda: c("T2M") - 273.15)
    add("shear", "U10 V10 U_925 V_925", lambda: F.hypot(c("U_925") - c("U10"), c("V_925") - c("V10")))
    add("turn", "U10 V10 U_925 V_925", lambda: (F.lit(1.0) - F.cos(F.atan2("V_925", "U_925") - F.atan2("V10", "U10"))) * 0.5)
    if "shear" in out:
        add("vent", "WSPD10", lambda: F.tanh(c("WSPD10") * (out["shear"] + 1.0) / 12.0))
    add("strat", "Q_1000 Q_925", lambda: F.tanh((c("Q_1000") - c("Q_925")) * 1500.0))
    add("convective", "CAPE PRECIP", lambda: sigmoid((F.log1p(clip(c("CAPE"), low=0.0)) - F.log(F.lit(200.0))) * 1.6) * sigmoid((F.log1p(clip(c("PRECIP"), low=0.0)) - F.log(F.lit(0.1))) * 2.5))
    add("mixing", "SW_RAD WSPD10 INVERSION", lambda: sigmoid((clip(c("SW_RAD"), low=0.0) - 150.0) / 75.0) * sigmoid((c("WSPD10") - 4.0) / 1.5) * sigmoid((F.lit(0.5) - c("INVERSION")) / 1.2))
    add("omega", "W_925 W_1000", lambda: F.tanh((c("W_925") - c("W_1000")) / 0.25))
    add("warm", "INVERSION T2M", lambda: F.tanh((clip(c("T2M") - (273.15 + 18.0), low=0.0) * 0.25 - c("INVERSION")) / 3.0))
    add("moist_heat", "RH2M T2M", lambda: c("RH2M") * F.exp((F.lit(273.15) - c("T2M")) / 10.0))
    add("rh_cloud", "RH2M LCC", lambda: c("RH2M") / (c("LCC") * 100.0 + 1.0))
    add("rh_contrast", "RH2M RH_925", lambda: F.tanh((c("RH2M") - c("RH_925")) / 50.0))
    if "night" in out:
        out["night_rad"] = out["night"] * out["clear"] * out["dim"] if {"clear", "dim"} <= set(out) else out["night"]
    return out


def _weighted(terms: list[tuple[float, Column]]) -> Column:
    total = sum(w for w, _ in terms)
    return sum((x * w for w, x in terms), start=F.lit(0.0)) / total


def _finished(df: DataFrame, keys: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """The features, missing as 0 and infinite ones as 10; computed in a projection of their own, then cleaned."""
    inf = float("inf")
    safe = lambda x: F.when(x == inf, 10.0).when(x == -inf, -10.0).when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    raw = df.select(*keys, *[x.alias(k) for k, x in cols.items()])
    return raw.select(*keys, *[safe(F.col(k)).alias(k) for k in cols])


def _stats(names: Sequence[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in names:
        out |= {k.lower(): x for k, x in window_stats(n).items()}
    return out


def fog_features_native(df: DataFrame, keys: Sequence[str] = ("station_id", "h")) -> DataFrame:
    """Fog features of the columns that df has (canonical names, ZENITH), from rows in series; missing is 0."""
    series = [n for n in ("RH2M", "T2M", "WSPD10", "DPD", "RH_925", "Q_1000", "Q_925") if n in df.columns]
    df = with_last(df, series) if series else df
    t = _helpers(df)
    cols: dict[str, Column] = {}
    terms: list[tuple[float, Column]] = []
    if "rh" in t and "dpd" in t:
        cols["moist"] = t["rh"] * t["dpd"]
        terms += [(FOG_WEIGHTS["rh"], t["rh"]), (FOG_WEIGHTS["dpd"], t["dpd"])]
    elif "dpd" in t:
        cols["moist"] = t["dpd"]
        terms.append((FOG_WEIGHTS["dpd_alone"], t["dpd"]))
    for name, source, term in (("wind", "wind", "wind"), ("stability", "stability", "stability"), ("night", "night_rad", "night_rad")):
        if source in t:
            cols[name if name != "night" else "night_rad"] = t[source]
            terms.append((FOG_WEIGHTS[name], clip(t[term], 0.0, 1.0) if name == "stability" else t[term]))
    if "rh_contrast" in t:
        cols["rh_contrast"] = t["rh_contrast"]
    if terms:
        cols["fog_potential"] = _weighted(terms)
    cols |= _stats(series)
    if "shear" in t:
        cols |= {"shear": F.tanh(t["shear"] / 8.0), "turn": t["turn"]}
    cols |= {k: t[k] for k in ("vent", "convective", "mixing", "strat", "omega", "warm", "moist_heat", "rh_cloud") if k in t}
    return _finished(df, keys, cols)


def fog_features_full(df: DataFrame, keys: Sequence[str] = ("station_id", "h")) -> DataFrame:
    """The 32 features of the full layout."""
    df = with_last(df, ["RH2M", "T2M", "WSPD10"])
    t, c = _helpers(df), F.col
    flag = (c("RH2M") > 90) & (t["t_c"] < 10) & (c("WSPD10") < 4)
    cols = {"moist": t["rh"] * t["dpd"], "wind": t["wind"], "stability": t["stability"], "night_rad": t["night_rad"], "rh_contrast": t["rh_contrast"],
            "fog_potential": t["rh"] * 0.4 + t["wind"] * 0.25 + clip(t["stability"], 0.0, 1.0) * 0.2 + t["night_rad"] * 0.15}
    cols |= _stats(["RH2M", "T2M", "WSPD10"])
    cols |= {"rh_accel": acceleration("RH2M"), "moist_heat": t["moist_heat"], "night_clear": t["night"] * (F.lit(1.0) - c("LCC")),
             "fog_rule": flag.cast("double"), "rh_cloud": t["rh_cloud"], "rh_squared": F.pow(c("RH2M") / 100.0, 2.0), "shear": F.tanh(t["shear"] / 8.0)}
    cols |= {k: t[k] for k in ("turn", "convective", "mixing", "vent", "strat", "omega", "warm")}
    return _finished(df, keys, cols)


def fog_features_compact(df: DataFrame, keys: Sequence[str] = ("station_id", "h")) -> DataFrame:
    """The 27 features of the layout without RH2M; the pressure anomaly is from the median of the whole table."""
    median = exact_quantiles(df, [], {"v": F.col("MSLP")}, {"_median": ("v", 0.5)})  # one row
    df = with_last(df.crossJoin(F.broadcast(median)), ["T2M", "WSPD10", "DPD"])
    t, c = _helpers(df), F.col
    cols = {"dpd_weight": t["dpd"], "wind": t["wind"], "rh925": t["rh925"], "fog_potential": t["dpd"] * 0.45 + t["rh925"] * 0.25 + t["wind"] * 0.15 + t["night"] * 0.15}
    cols |= _stats(["T2M", "WSPD10", "DPD"])
    cols |= {"dpd_accel": acceleration("DPD"), "dpd_heat": t["dpd"] * F.exp(t["t_c"] / -10.0), "night_moist": ((t["night"] > 0) & (c("DPD") < 2)).cast("double"),
             "fog_rule": ((c("DPD") < 2) & (t["t_c"] < 10) & (c("WSPD10") < 4)).cast("double"), "dpd_squared": F.pow(t["dpd"], 2.0), "shear": F.tanh(t["shear"] / 8.0),
             "turn": t["turn"], "vent": t["vent"], "strat": t["strat"], "dp_contrast": F.tanh((c("DP_1000") - c("DP_925")) / 8.0),
             "pressure_anomaly": F.tanh((c("MSLP") - c("_median")) / 2000.0)}
    return _finished(df, keys, cols)
