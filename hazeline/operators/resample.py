"""Bootstraps and permutation importance on pre-aggregated counts.

A resample never copies samples: metrics depend on counts by cell or by date alone, so draws are joined to a
table of one row a date (or cell).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.operators.splits import permuted_pairs
from hazeline.operators.verify import LOWER_IS_BETTER, argmax_class, metrics, ratio
from hazeline.sources.sinks import stored


def bootstrap_rows(pairs: DataFrame, metric: str, n_rep: int = 500, seed: int = 17) -> DataFrame:
    """mean, low, high (95 %) and observed difference of a metric between two forecasts over resampled rows.

    pairs: y_cls, a_pred, b_pred. Drawing n rows of n is drawing the 27 cells' counts from a multinomial law,
    so n_rep draws are made from at most 27 counts.
    """
    spark = pairs.sparkSession
    cells = pairs.groupBy("y_cls", "a_pred", "b_pred").agg(F.count("*").alias("n")).orderBy("y_cls", "a_pred", "b_pred").collect()
    n = np.array([c["n"] for c in cells], float)
    draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=n_rep)
    counts = np.vstack([n.astype(int), draws])
    rows = [(r, int(c["y_cls"]), int(c["a_pred"]), int(c["b_pred"]), int(k)) for r, row in enumerate(counts) for c, k in zip(cells, row, strict=True)]
    reps = spark.createDataFrame(rows, "rep int, y_cls int, a_pred int, b_pred int, n long")
    side = lambda s: reps.groupBy("rep", "y_cls", F.col(f"{s}_pred").alias("pred")).agg(F.sum("n").alias("n"))
    a = metrics(side("a"), ["rep"]).select("rep", F.col(metric).alias("a"))
    both = a.join(metrics(side("b"), ["rep"]).select("rep", F.col(metric).alias("b")), "rep").withColumn("d", F.col("a") - F.col("b"))
    again = F.when(F.col("rep") > 0, F.col("d"))
    return both.agg(
        F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("observed"), F.avg(again).alias("mean"), F.percentile(again, 0.025).alias("low"), F.percentile(again, 0.975).alias("high")
    )


#: Blocks that the cells and the replicates of a bootstrap are dealt into; a task multiplies one of each.
CELL_BLOCKS, REP_BLOCKS = 4, 4


def date_picks(dates: DataFrame, day: str, n_rep: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rep, picks): the places of the dates that each replicate draws, by md5; with n dates n are drawn. And (day, place)."""
    placed = dates.select(day).distinct().withColumn("place", F.row_number().over(Window.orderBy(day)) - 1)  # one row a date
    n = placed.agg(F.count("*").alias("_n"))
    reps = dates.sparkSession.range(n_rep).select(F.col("id").alias("rep")).crossJoin(F.broadcast(n))
    return reps.filter("_n > 0").mapInPandas(partial(_picked, seed), "rep long, picks array<int>"), placed


def _picked(seed: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As splits.draw draws: the first 32 bits of the md5 of seed, replicate and slot, modulo the number of dates."""
    for reps in batches:
        rows = []
        for rep, n in zip(reps["rep"], reps["_n"], strict=True):
            start = f"{seed}|{rep}|"
            first = b"".join([hashlib.md5(f"{start}{slot}".encode()).digest()[:4] for slot in range(n)])
            rows.append((np.frombuffer(first, ">u4") % n).astype(np.int32))
        yield pd.DataFrame({"rep": reps["rep"], "picks": rows})


def drawn_sums(counts: DataFrame, cell: Sequence[str], values: Sequence[str], n_rep: int, seed: str, day: str = "day") -> DataFrame:
    """rep, cell, values: the sums of each cell over the dates that each replicate draws (a date as often as it is drawn); cells
    without a drawn date have no row.

    The replicates are rows of a matrix (times by date), the cells columns of another, and blocks of cells are multiplied in
    tasks: nothing that is drawn is joined or summed by a shuffle. A task holds a block of cells over all dates and 128
    replicates at a time."""
    counts = stored(counts.select(*cell, day, *values), "daily-counts")  # a row a date and cell, read twice
    picks, placed = date_picks(counts, day, n_rep, seed)
    kinds = dict(counts.dtypes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = counts.join(placed, day).select(*cell, "place", *values).withColumns({"_a": F.pmod(F.xxhash64(*cell), F.lit(CELL_BLOCKS)).cast("int"), "_b": every(REP_BLOCKS)})
    drawn = picks.withColumns({"_b": F.pmod("rep", F.lit(REP_BLOCKS)).cast("int"), "_a": every(CELL_BLOCKS)})
    schema = ", ".join(["rep long", *(f"`{c}` {kinds[c]}" for c in cell), *(f"`{v}` {'double' if kinds[v] == 'double' else 'long'}" for v in values)])
    whole = [v for v in values if kinds[v] != "double"]
    return rows.groupBy("_a", "_b").cogroup(drawn.groupBy("_a", "_b")).applyInPandas(partial(_multiplied, list(cell), list(values), whole), schema)


def _multiplied(cell: list[str], values: list[str], whole: list[str], rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(drawn):
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ["rep", *cell, *values]})
    number, names = pd.factorize(pd.MultiIndex.from_frame(rows[cell]))
    n_dates = len(drawn["picks"].iloc[0])
    at = rows["place"].to_numpy(), number
    held = np.zeros((n_dates, len(names)))
    np.add.at(held, at, 1.0)
    sums = []
    for v in values:
        m = np.zeros_like(held)
        np.add.at(m, at, rows[v].to_numpy(float))
        sums.append(m)
    out = []
    for start in range(0, len(drawn), 128):
        part = drawn.iloc[start : start + 128]
        times = np.array([np.bincount(x, minlength=n_dates) for x in part["picks"]], float)
        rep, c = np.nonzero(times @ held)
        found = {"rep": part["rep"].to_numpy()[rep]} | {k: names.get_level_values(i).to_numpy()[c] for i, k in enumerate(cell)}
        found |= {v: (times @ m)[rep, c] for v, m in zip(values, sums, strict=True)}
        out.append(pd.DataFrame(found))
    table = pd.concat(out, ignore_index=True)
    return table.astype({v: "int64" for v in whole})


def _interval(reps: DataFrame, by: Sequence[str], value: Column, *more: Column) -> DataFrame:
    return reps.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"),
        (F.count_if(value > 0) / F.count("*")).alias("p_positive"), *more, F.count("*").alias("n_rep"),
    )


def bootstrap_dates(counts: DataFrame, reference: str, names: Sequence[str], n_rep: int = 1000, seed: str = "dates") -> DataFrame:
    """source, metric, mean, low, high, p_positive, p_better, n_blocks, n_rep of source minus reference over resampled dates.

    counts: source, day, y_cls, pred, n and, for the Brier scores, the sums multiclass_sq and low_vis_sq. p_better is the
    share of replicates in which the source is better by the metric's direction.
    """
    sums = [c for c in ("multiclass_sq", "low_vis_sq") if c in counts.columns]
    drawn = drawn_sums(counts, ["source", "y_cls", "pred"], ["n", *sums], n_rep, seed)
    table = metrics(drawn, ["rep", "source"])
    if sums:
        scores = drawn.groupBy("rep", "source").agg(*[(F.sum(c) / F.sum("n")).alias(c.replace("_sq", "_brier")) for c in sums])
        table = table.join(scores, ["rep", "source"])
    long = table.select("rep", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("m")).select("rep", "source", "m.*")
    ref = long.filter(F.col("source") == reference).select("rep", "metric", F.col("v").alias("_ref"))
    both = long.filter(F.col("source") != reference).join(ref, ["rep", "metric"])
    blocks = counts.agg(F.count_distinct("day").alias("n_blocks"))  # one row
    d = F.col("v") - F.col("_ref")
    better = F.count_if(F.when(F.col("metric").isin(*LOWER_IS_BETTER), d < 0).otherwise(d > 0)) / F.count("*")
    return _interval(both, ["source", "metric"], d, better.alias("p_better")).crossJoin(F.broadcast(blocks))


def linear_scores(df: DataFrame, names: Sequence[str], weights: Sequence[Sequence[float]], temperature: float = 1.0) -> DataFrame:
    """df with p_fog, p_mist, p_clear: softmax of three linear scores over T."""
    z = [sum((F.col(n) * w for n, w in zip(names, ws[1:], strict=True)), start=F.lit(float(ws[0]))) / temperature for ws in weights]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = e[0] + e[1] + e[2]
    return df.withColumns({p: x / total for p, x in zip(("p_fog", "p_mist", "p_clear"), e, strict=True)})


def batch_score(df: DataFrame, scorer, names: Sequence[str], temperature: float = 1.0, scaler: DataFrame | None = None) -> DataFrame:
    """df with probabilities by a user's scorer: a function from a numpy matrix (rows, names) to logits (rows, 3).

    It runs on Arrow batches in the tasks; the only place of user code. With a scaler (name, center, scale) the scorer
    gets the fitted transform of the columns, and df keeps its own.
    """
    schema = df.withColumns({p: F.lit(0.0) for p in ("p_fog", "p_mist", "p_clear")}).schema
    given = df
    inputs = list(names)
    if scaler is not None:
        inputs = [f"_in_{n}" for n in names]
        given = scaled_inputs(df, names, scaler, "_in_")

    def run(batches):
        for pdf in batches:
            z = np.asarray(scorer(pdf[inputs].to_numpy(float)), float) / temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            yield pdf.assign(p_fog=p[:, 0], p_mist=p[:, 1], p_clear=p[:, 2])[schema.names]

    return given.mapInPandas(run, schema)


def scaled_inputs(df: DataFrame, names: Sequence[str], scaler: DataFrame, prefix: str = "") -> DataFrame:
    """df with <prefix><name> for each of names as a model takes it: (value - center) / (scale + 1e-6) within 10, missing as 0;
    scaler has a row (name, center, scale) for each. Fails where it lacks one."""
    entry = F.struct("name", F.struct(F.col("center").cast("double").alias("center"), F.col("scale").cast("double").alias("scale")).alias("s"))
    packed = scaler.filter(F.col("name").isin(*names)).agg(F.map_from_entries(F.collect_list(entry)).alias("_scaler"))
    joined = df.crossJoin(F.broadcast(packed))  # one row

    def scaled(n: str) -> Column:
        s = F.coalesce(F.element_at("_scaler", n), F.raise_error(f"the scaler lacks {n}").cast("struct<center:double,scale:double>"))
        value = F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))
        z = (F.coalesce(value, s["center"]) - s["center"]) / (s["scale"] + 1e-6)
        return F.least(F.greatest(z, F.lit(-10.0)), F.lit(10.0))

    return joined.withColumns({f"{prefix}{n}": scaled(n) for n in names}).drop("_scaler")


def event_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp, fp, fn, sq_error, n of low visibility."""
    pred = argmax_class([F.col(p) for p in ("p_fog", "p_mist", "p_clear")])
    y, p = F.col("y_cls") <= 1, pred <= 1
    sq = F.pow(F.col("p_fog") + F.col("p_mist") - y.cast("double"), 2.0)
    return df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.sum(sq).alias("sq_error"), F.count("*").alias("n"))


def event_scores(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sq_error", "n")])
    return s.select(*by, ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("csi"), (F.col("sq_error") / F.col("n")).alias("brier"))


def permuted(df: DataFrame, donors: DataFrame, key: str, groups: Mapping[str, Sequence[str]], strata: Sequence[str] = ("source",), anchors: Mapping[str, str | None] | None = None, whole: bool = False) -> DataFrame:
    """mode, rep, feature and the columns of df, once for each row of donors and each group: those of the group are the donor's,
    whole windows where they are arrays of steps. Mode 'none' has its row once, as feature 'baseline'.

    donors: mode, rep, strata, key, donor and, where anchors names one for each group, the anchor that chose it. One join for all
    modes, repeats and groups: a row meets its donor's values once and the groups are rewrites of it in the same task. The rows of
    mode 'none' are those of df that donors names in it, once each also where they share a key; all of df, not joined, where
    whole says that donors names them all, as a donor_table of df does.
    """
    columns = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    given = df.select(*[F.col(c).alias(f"_{c}") for c in (*strata, key)], F.struct(*columns).alias("_given"))
    chosen = donors.filter("mode <> 'none'").select("mode", "rep", *(["anchor"] if anchors else []), *strata, key, "donor")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strata]
    met = chosen.join(df, [*strata, key]).join(given, [*same, F.col("donor") == F.col(f"_{key}")])
    out = _rewritten(met, df.columns, groups, anchors)
    if not whole:
        named = donors.filter("mode = 'none'").select(*[F.col(c).alias(f"_{c}") for c in (*strata, key)])
        df = df.join(named, [*same, F.col(key) == F.col(f"_{key}")], "left_semi")
    return out.unionByName(_baseline(df))


def _baseline(df: DataFrame) -> DataFrame:
    return df.select(F.lit("none").alias("mode"), F.lit(0).alias("rep"), F.lit("baseline").alias("feature"), *df.columns)


def _rewritten(met: DataFrame, kept: Sequence[str], groups: Mapping[str, Sequence[str]], anchors: Mapping[str, str | None] | None) -> DataFrame:
    """mode, rep, feature and the columns kept of met (mode, rep, anchor with anchors, _given), once for each group: its columns are those of _given."""
    columns = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    rewrites = []
    for name, cs in groups.items():
        values = F.struct(*[(F.col(f"_given.{c}") if c in cs else F.col(c)).alias(c) for c in columns])
        mine = (F.col("mode") != "stratified") | (F.col("anchor") == (anchors[name] or "")) if anchors else F.lit(True)
        rewrites.append(F.when(mine, F.struct(F.lit(name).alias("feature"), values.alias("x"))))
    rest = [c for c in kept if c not in columns]
    out = met.select("mode", "rep", *rest, F.explode(F.filter(F.array(*rewrites), lambda r: r.isNotNull())).alias("_r"))
    return out.select("mode", "rep", "_r.feature", *rest, "_r.x.*")


def permutation_importance(
    df: DataFrame, score, key: str, groups: Mapping[str, Sequence[str]], donors: DataFrame, by: Sequence[str] = ("source", "day"), strata: Sequence[str] = ("source",), anchors: Mapping[str, str | None] | None = None
) -> DataFrame:
    """feature, mode, rep, by..., tp, fp, fn, sq_error, n: event counts by date with a group permuted (feature 'baseline', mode
    'none': nothing).

    score adds probabilities to rows; donors is a donor_table of df. All rewrites are scored in one pass and counted before
    they are shuffled.
    """
    return event_counts(score(permuted(df, donors, key, groups, strata, anchors, whole=True)), ["feature", "mode", "rep", *by])


def seeded_importance(
    df: DataFrame, score, key: str, groups: Mapping[str, Sequence[str]], seed: str, repeats: int, strata: Mapping[str, tuple[Sequence[str], Sequence[str]]], by: Sequence[str] = ("source", "day"),
    within: Sequence[str] = ("source",), anchors: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """permutation_importance with the donors of donor_table(df, key, seed, repeats, within, strata); df holds the strata's columns.

    Values are permuted themselves, so that no row is joined to its donor by key."""
    given = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    levels = {c for fine, coarse in strata.values() for c in (*fine, *coarse)}
    met = permuted_pairs(df, key, seed, repeats, given, within, strata)
    kept = [c for c in df.columns if c not in levels and c != key]
    return event_counts(score(_rewritten(met, kept, groups, anchors).unionByName(_baseline(df.select(*kept)))), ["feature", "mode", "rep", *by])


def importance(daily: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """by, feature, mode, baseline_csi, csi_drop, brier_rise: means over repeats, against the baseline."""
    s = event_scores(daily, [*by, "feature", "mode", "rep"])
    base = s.filter("feature = 'baseline'").select(*by, F.col("csi").alias("_c"), F.col("brier").alias("_b"))
    both = s.filter("feature <> 'baseline'").join(base, list(by))
    return both.groupBy(*by, "feature", "mode").agg(
        F.max("_c").alias("baseline_csi"), F.avg(F.col("_c") - F.col("csi")).alias("csi_drop"), F.avg(F.col("brier") - F.col("_b")).alias("brier_rise")
    )


def importance_replicates(daily: DataFrame, n_rep: int, seed: str, n_repeats: int, by: Sequence[str] = ("source",)) -> DataFrame:
    """draw, by, feature, mode, metric (csi_drop, brier_rise), value: over resampled dates, shared by all sources and features;
    each draw uses one repeat."""
    again = daily.withColumnRenamed("rep", "repeat")
    drawn = drawn_sums(again, [*by, "feature", "mode", "repeat"], ["tp", "fp", "fn", "sq_error", "n"], n_rep, seed)
    mine = (F.col("feature") == "baseline") | (F.col("repeat") == F.pmod("rep", F.lit(n_repeats)) + 1)
    weighted = drawn.filter(mine).withColumnRenamed("rep", "draw")
    s = event_scores(weighted, ["draw", *by, "feature", "mode"])
    base = s.filter("feature = 'baseline'").select("draw", *by, F.col("csi").alias("_c"), F.col("brier").alias("_b"))
    both = s.filter("feature <> 'baseline'").join(base, ["draw", *by])
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    pair = F.array(metric("csi_drop", F.col("_c") - F.col("csi")), metric("brier_rise", F.col("brier") - F.col("_b")))
    return both.select("draw", *by, "feature", "mode", F.explode(pair).alias("m")).select("draw", *by, "feature", "mode", "m.*")


def importance_ci(daily: DataFrame, n_rep: int = 1000, seed: str = "importance", n_repeats: int = 1, least_dates: int = 5, by: Sequence[str] = ("source",)) -> DataFrame:
    """by, feature, mode, metric, mean, low, high, p_positive, n_rep, excludes_zero; empty with fewer than least_dates dates."""
    dates = daily.agg(F.count_distinct("day").alias("_d"))  # one row
    out = _interval(importance_replicates(daily, n_rep, seed, n_repeats, by), [*by, "feature", "mode", "metric"], F.col("value"))
    out = out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
    return out.crossJoin(F.broadcast(dates)).filter(F.col("_d") >= least_dates).drop("_d")


def importance_source_diff(reps: DataFrame, manifest: DataFrame) -> DataFrame:
    """feature, mode, metric, left_source, right_source, scope, mean, low, high, p_positive, n_rep of left - right over paired draws.

    reps: importance_replicates by source; manifest: source, feature, members. Features are comparable where both sources
    have equal members; scope is global_shared when all sources do.
    """
    n = manifest.agg(F.count_distinct("source").alias("_all"))
    same = manifest.groupBy("feature", "members").agg(F.count_distinct("source").alias("_k")).crossJoin(F.broadcast(n))  # one row
    scope = same.select("feature", "members", F.when(F.col("_k") == F.col("_all"), "global_shared").otherwise("pair_shared").alias("scope"))
    tagged = reps.join(manifest, ["source", "feature"]).join(scope, ["feature", "members"])
    keys = ["draw", "feature", "mode", "metric", "members"]
    l = tagged.select(*keys, "scope", F.col("source").alias("left_source"), F.col("value").alias("_l"))  # noqa: E741
    r = tagged.select(*keys, F.col("source").alias("right_source"), F.col("value").alias("_r"))
    both = l.join(r, keys).filter(F.col("left_source") < F.col("right_source"))
    return _interval(both, ["feature", "mode", "metric", "left_source", "right_source", "scope"], F.col("_l") - F.col("_r"))


def feature_group_manifest(available: DataFrame, packages: DataFrame, steps: int = 12, importances: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """source, feature, members, kind, n_columns, rank and, with importances (source, feature, value), importance_rank and
    selected: each variable of a source and each package (name, member) with its members that the source has.

    A group is permuted with the whole window, so it has steps columns a member. rank numbers the groups of a source,
    variables first; importance_rank those with a value, the largest first; the first k of them are selected (all without k).
    """
    single = available.select("source", F.col("name").alias("feature"), F.array("name").alias("_m"), F.lit("variable").alias("kind"))
    held = available.join(packages, F.col("name") == F.col("member")).groupBy("source", "package")
    held = held.agg(F.array_sort(F.collect_set("member")).alias("_m"))
    shared = F.when(F.col("package").startswith("shared_"), "shared_package").otherwise("package")
    out = single.union(held.select("source", F.col("package").alias("feature"), "_m", shared.alias("kind")))
    order = Window.partitionBy("source").orderBy(F.col("kind").desc(), "feature")  # a row a group of the source
    out = out.select("source", "feature", F.array_join("_m", ",").alias("members"), "kind", (F.size("_m") * steps).cast("long").alias("n_columns"))
    out = out.withColumn("rank", F.row_number().over(order).cast("long"))
    if importances is None:
        return out
    out = out.join(importances.select("source", "feature", "value"), ["source", "feature"], "left")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("value"), "feature")).cast("long")
    out = out.withColumn("importance_rank", F.when(F.col("value").isNotNull(), place)).drop("value")
    chosen = F.col("importance_rank").isNotNull() if k is None else F.coalesce(F.col("importance_rank") <= k, F.lit(False))
    return out.withColumn("selected", chosen)


def top_k_features(importances: DataFrame, populated: DataFrame, k: int, explicit: Sequence[str] = (), default: Sequence[str] = ()) -> DataFrame:
    """feature, value: at most k features populated in all sources of populated (source, feature): those of explicit in its
    order, then by importance, the largest first and by name on ties, then those of default in its order."""
    n = populated.agg(F.count_distinct("source").alias("_n"))
    everywhere = populated.groupBy("feature").agg(F.count_distinct("source").alias("_k")).crossJoin(F.broadcast(n)).filter("_k = _n").select("feature")  # one row
    rows = everywhere.join(importances.select("feature", "value"), "feature", "left")
    place = lambda xs: F.nullif(F.array_position(F.array(*[F.lit(x) for x in xs]).cast("array<string>"), F.col("feature")), F.lit(0))
    first, last = place(explicit), place(default)
    rows = rows.filter(first.isNotNull() | F.col("value").isNotNull() | last.isNotNull())
    return rows.orderBy(F.asc_nulls_last(first), F.desc_nulls_last("value"), F.asc_nulls_last(last), "feature").limit(k)
