"""Verification of class forecasts: contingency and probability scores, threshold search, comparison.

Scores are computed from counts by (truth, forecast), so every metric, scenario and delta works on a few
rows a source whatever the number of samples. A ratio whose denominator is 0 is 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.quantiles import exact_quantiles, with_quantiles
from hazeline.functions.ranks import running_totals
from hazeline.sources.sinks import stored

CLASSES = ("fog", "mist", "clear")
PROBS = ("p_fog", "p_mist", "p_clear")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _whole(p: Sequence[Column]) -> Column:
    """Whether no probability is null or NaN, by one test of their sum: NaN sorts above infinity, null gives null."""
    return p[0] + p[1] + p[2] <= F.lit(float("inf"))


def argmax_class(p: Sequence[Column]) -> Column:
    """The class of the largest probability, the first on ties; null where one is null or no number."""
    return F.when(_whole(p), F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2))


def threshold_class(p: Sequence[Column], fog: Column, mist: Column) -> Column:
    """Fog over its threshold and over mist; else mist likewise; else clear. Without thresholds the argmax. Null where a
    probability is null or no number."""
    fixed = F.when(_whole(p), F.when((p[0] > fog) & (p[0] > p[1]), 0).when((p[1] > mist) & (p[1] > p[0]), 1).otherwise(2))
    return F.when(fog.isNull() | mist.isNull() | F.isnan(fog) | F.isnan(mist), argmax_class(p)).otherwise(fixed)


def with_pred(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", argmax_class([F.col(p) for p in PROBS]))


def confusion_matrix(df: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """n by (by, y_cls, pred) for codes 0 to 2."""
    counts = df.groupBy(*by, "y_cls", "pred").agg(F.count("*").alias("n"))
    # The few groups are filtered, not the rows; `having` on codes of the groups alone would be pushed below the count.
    known = F.col("n").isNotNull() & F.col("y_cls").between(0, 2) & F.col("pred").between(0, 2)
    return counts.filter(F.when(F.col("n") > 0, known))


def _cells(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    cell = lambda i, j: F.coalesce(F.sum(F.when((F.col("y_cls") == i) & (F.col("pred") == j), F.col("n"))), F.lit(0))
    return counts.groupBy(*by).agg(*[cell(i, j).alias(f"c{i}{j}") for i in range(3) for j in range(3)])


def _class_columns(i: int, name: str) -> dict[str, Column]:
    c = lambda a, b: F.col(f"c{a}{b}")
    tp, support, predicted = c(i, i), sum(c(i, j) for j in range(3)), sum(c(j, i) for j in range(3))
    fp, fn = predicted - tp, support - tp
    return {
        f"{name}_precision": ratio(tp, tp + fp), f"{name}_{'recall' if name == 'clear' else 'pod'}": ratio(tp, tp + fn),
        f"{name}_f1": ratio(2 * tp, 2 * tp + fp + fn), f"{name}_csi": ratio(tp, tp + fp + fn), f"{name}_far": ratio(fp, tp + fp),
        f"{name}_support": support, f"{name}_predicted": predicted,
    }


def metrics(counts: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """A row a group with class, summary and low-visibility metrics, from counts (by, y_cls, pred, n)."""
    wide = _cells(counts, by)
    c = lambda a, b: F.col(f"c{a}{b}")
    cols: dict[str, Column] = {}
    for i, name in enumerate(CLASSES):
        cols |= _class_columns(i, name)
    total = sum(c(i, j) for i in range(3) for j in range(3))
    tp = c(0, 0) + c(0, 1) + c(1, 0) + c(1, 1)
    fp, fn, clear = c(2, 0) + c(2, 1), c(0, 2) + c(1, 2), c(2, 0) + c(2, 1) + c(2, 2)
    cols |= {
        "n": total, "accuracy": ratio(c(0, 0) + c(1, 1) + c(2, 2), total),
        "macro_f1": (cols["fog_f1"] + cols["mist_f1"] + cols["clear_f1"]) / 3.0,
        "weighted_f1": ratio(sum(cols[f"{k}_f1"] * cols[f"{k}_support"] for k in CLASSES), total),
        "low_vis_precision": ratio(tp, tp + fp), "low_vis_pod": ratio(tp, tp + fn), "low_vis_f1": ratio(2 * tp, 2 * tp + fp + fn),
        "low_vis_csi": ratio(tp, tp + fp + fn), "low_vis_far": ratio(fp, tp + fp), "low_vis_fpr": ratio(fp, clear),
    }
    out = wide.select(*by, *[x.alias(k) for k, x in cols.items()])
    return out.withColumn("target_achievement", target_achievement())


#: Metric, goal and weight (fixed values); the last is 1 - false positive rate.
GOALS = (("fog_pod", 0.65, 0.30), ("mist_pod", 0.75, 0.30), ("accuracy", 0.95, 0.25), ("low_vis_precision", 0.20, 0.10), ("fpr", 0.60, 0.05))


def target_achievement() -> Column:
    value = lambda k: F.lit(1.0) - F.col("low_vis_fpr") if k == "fpr" else F.col(k)
    return sum((F.least(value(k) / goal, F.lit(1.0)) * w for k, goal, w in GOALS), start=F.lit(0.0))


def brier(df: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Mean multiclass and low-visibility Brier scores."""
    hit = lambda i: F.when(F.col("y_cls") == i, 1.0).otherwise(0.0)
    multi = sum(F.pow(F.col(p) - hit(i), 2.0) for i, p in enumerate(PROBS))
    low = F.pow(F.col("p_fog") + F.col("p_mist") - F.when(F.col("y_cls") <= 1, 1.0).otherwise(0.0), 2.0)
    return df.groupBy(*by).agg(F.avg(multi).alias("multiclass_brier"), F.avg(low).alias("low_vis_brier"))


def expected_calibration_error(df: DataFrame, score: Column, outcome: Column, by: Sequence[str] = ("source",), bins: int = 15) -> DataFrame:
    """ece: the mean over rows of |mean score - mean outcome| of their bin; the last bin is closed."""
    binned = df.select(*by, score.alias("_s"), outcome.cast("double").alias("_o"))
    binned = binned.withColumn("_bin", F.least(F.floor(F.col("_s") * bins), F.lit(bins - 1)))
    per = binned.groupBy(*by, "_bin").agg(F.count("*").alias("n"), F.avg("_s").alias("s"), F.avg("_o").alias("o"))
    return per.groupBy(*by).agg(ratio(F.sum(F.col("n") * F.abs(F.col("s") - F.col("o"))), F.sum("n")).alias("ece"))


def average_precision(df: DataFrame, score: Column, positive: Column, by: Sequence[str] = ("source",)) -> DataFrame:
    """ap: precision summed over the steps of recall, distinct scores descending; null with one class alone."""
    rows = df.select(*by, score.alias("_s"), positive.cast("long").alias("_p"))
    steps = rows.groupBy(*by, "_s").agg(F.sum("_p").alias("pos"), F.count("*").alias("n"))
    steps = running_totals(steps, by, [-F.col("_s")], {"tp": F.col("pos"), "seen": F.col("n")}, lambda d: stored(d, "score-ranges"))
    out = steps.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("a"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("a") / F.col("p")).alias("ap"))


def threshold_grid(policy: str = "operational") -> list[float]:
    low = [0.01 * (i + 1) for i in range(49)] if policy == "response" else [0.10 + 0.04 * i for i in range(10)]
    return low + [0.50 + 0.03 * i for i in range(16)]


def _threshold_cells(df: DataFrame, grid: list[float], by: Sequence[str]) -> DataFrame:
    """n by (by, y_cls, side, k): a row matters through its class, the side of its larger low-visibility probability, and
    the number k of thresholds under it: at most 3 * 3 * (points + 1) counts a group."""
    side = F.when(F.col("p_fog") > F.col("p_mist"), "fog").when(F.col("p_mist") > F.col("p_fog"), "mist").otherwise("none")
    larger = df.select(*by, "y_cls", side.alias("side"), F.greatest("p_fog", "p_mist").alias("_p"))
    under = F.lit(len(grid))  # the thresholds ascend: the first that isn't under the probability says how many are
    for i in reversed(range(len(grid))):
        under = F.when(F.coalesce(F.col("_p") <= grid[i], F.lit(True)), i).otherwise(under)
    return larger.groupBy(*by, "y_cls", "side", under.alias("k")).agg(F.count("*").alias("n"))


def _threshold_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """n by (by, side, y_cls, i): rows that threshold number i of their side would call; and all rows as side 'all'."""
    called = cells.filter("side <> 'none' and k > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    called = called.groupBy(*by, "side", "y_cls", "i").agg(F.sum("n").alias("n"))
    every = cells.groupBy(*by, "y_cls").agg(F.sum("n").alias("n")).select(*by, F.lit("all").alias("side"), "y_cls", F.lit(0).alias("i"), "n")
    return called.union(every)


def threshold_table(df: DataFrame, by: Sequence[str] = ("source",), grid: list[float] | None = None) -> DataFrame:
    """The metrics of every pair of thresholds (fog_i, mist_i index the grid) for each group; exact."""
    grid = grid or threshold_grid()
    return _threshold_table(_threshold_cells(df, grid, by), by, grid)


def _threshold_table(cells: DataFrame, by: Sequence[str], grid: list[float]) -> DataFrame:
    # A row a group: filters on sides stay above it, so the rows are counted once for all uses.
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct("y_cls", "side", "k", "n")).alias("_c"))
    counts = _threshold_counts(packed.select(*by, F.explode("_c").alias("_c")).select(*by, "_c.*"), by)
    pick = lambda s, y: F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("y_cls") == y), F.col("n"))), F.lit(0))
    points = F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("i")
    totals = counts.filter("side = 'all'").groupBy(*by).agg(*[pick("all", y).alias(f"t{y}") for y in range(3)])
    frame = totals.select(*by, points)
    side = lambda s: (
        frame.join(counts.filter(F.col("side") == s), [*by, "i"], "left")
        .groupBy(*by, F.col("i").alias(f"{s}_i")).agg(*[pick(s, y).alias(f"{s}{y}") for y in range(3)])
    )
    both = side("fog").join(side("mist"), list(by)).join(totals, list(by))
    cells = [(y, j, F.col(f"{s}{y}") if s else F.col(f"t{y}") - F.col(f"fog{y}") - F.col(f"mist{y}")) for y in range(3) for j, s in ((0, "fog"), (1, "mist"), (2, ""))]
    long = both.select(*by, "fog_i", "mist_i", F.explode(F.array(*[F.struct(F.lit(y).alias("y_cls"), F.lit(j).alias("pred"), n.alias("n")) for y, j, n in cells])).alias("c"))
    return metrics(long.select(*by, "fog_i", "mist_i", "c.*"), [*by, "fog_i", "mist_i"])


def _first_best(table: DataFrame, score: Column, allowed: Column, by: Sequence[str], stage: str) -> DataFrame:
    """The best score of each group, on ties the first in grid order."""
    rows = table.filter(allowed).withColumn("score", F.round(score, 12))
    best = F.max_by(F.struct("fog_i", "mist_i", "score", "fog_precision", "mist_precision", "clear_recall"), F.struct("score", -F.col("fog_i"), -F.col("mist_i")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, "b.*", F.lit(stage).alias("stage"))


def threshold_search(df: DataFrame, by: Sequence[str] = ("source",), policy: str = "operational") -> DataFrame:
    """fog_th, mist_th, score, stage of each group; null thresholds (argmax) where no pair is allowed."""
    grid = threshold_grid(policy)
    table = threshold_table(df, by, grid)
    if policy == "response":
        score = F.col("fog_pod") * 0.30 + F.col("mist_pod") * 0.30 + F.col("low_vis_csi") * 0.25 + F.col("low_vis_precision") * 0.15 - F.col("low_vis_fpr") * 0.10
        found = [_first_best(table, score, F.col("fog_predicted") + F.col("mist_predicted") > 0, by, "response")]
    else:
        ok = lambda p, r: (F.col("fog_precision") >= p) & (F.col("mist_precision") >= p) & (F.col("clear_recall") >= r)
        short = lambda c: F.greatest(F.lit(0.10) - F.col(c), F.lit(0.0))
        score = F.col("target_achievement")
        found = [
            _first_best(table, score, ok(0.10, 0.90), by, "strict"),
            _first_best(table, score - short("fog_precision") - short("mist_precision"), ok(0.05, 0.88), by, "relaxed"),
        ]
    best = found[0]
    for other in found[1:]:
        best = best.union(other.join(best.select(*by), list(by), "left_anti"))
    points = F.array(*[F.lit(g) for g in grid])
    out = table.select(*by).distinct().join(best, list(by), "left")
    return out.select(
        *by, F.get(points, F.col("fog_i")).alias("fog_th"), F.get(points, F.col("mist_i")).alias("mist_th"), "score",
        F.coalesce("stage", F.lit("argmax")).alias("stage"),
    )


def mean_thresholds(found: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row fog_th, mist_th: the means over the members of threshold_search's result. Fails where a member has none."""
    held = found.filter(F.col("source").isin(*members)).agg(
        F.avg("fog_th").alias("fog_th"), F.avg("mist_th").alias("mist_th"), (F.count("fog_th") + F.count("mist_th")).alias("_n")
    )
    missing = F.raise_error("a member has no thresholds").cast("double")
    return held.select(F.when(F.col("_n") == 2 * len(members), F.col("fog_th")).otherwise(missing).alias("fog_th"), "mist_th")


SEASON_GRID = [0.10 + 0.03 * i for i in range(29)]


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isNotNull(), "SON")


def season_threshold_search(
    df: DataFrame, precision_floor: float = 0.20, recall_floor: float = 0.08, most_mist: float = 1.0, least_rows: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """Thresholds by group and season of df (by, season, y_cls, p_*): strict floors, then floors lower by 0.03, then the best of
    all rows of the group."""
    cells = _threshold_cells(df, SEASON_GRID, [*by, "season"])
    table = _threshold_table(cells, [*by, "season"], SEASON_GRID)
    sizes = cells.groupBy(*by, "season").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= least_rows)
    points = F.array(*[F.lit(g) for g in SEASON_GRID])
    mist_th = F.get(points, F.col("mist_i"))
    ok = lambda p, r: (F.col("fog_precision") >= 0.05) & (F.col("mist_precision") >= p) & (F.col("mist_pod") >= r) & (F.col("clear_recall") >= 0.85)
    score = F.col("target_achievement")
    capped = mist_th <= most_mist
    keys = [*by, "season"]
    strict = _first_best(table, score, ok(precision_floor, recall_floor) & capped, keys, "seasonal_strict")
    relaxed = _first_best(table, score, ok(max(0.10, precision_floor - 0.03), max(0.05, recall_floor - 0.03)) & capped, keys, "seasonal_relaxed")
    group = [*by, "all"]
    whole = _threshold_table(cells.drop("season").withColumn("all", F.lit("all")), group, SEASON_GRID)
    fallback = _first_best(whole, score, ok(0.15, 0.0), group, "global_fallback")
    best = strict.union(relaxed.join(strict.select(*keys), keys, "left_anti"))
    rest = sizes.select(*keys, F.lit("all").alias("all")).join(best.select(*keys), keys, "left_anti").join(fallback, group)
    best = best.union(rest.select(*best.columns))
    return sizes.join(best, keys).select(*keys, F.get(points, F.col("fog_i")).alias("fog_th"), mist_th.alias("mist_th"), "score", F.col("stage").alias("origin"))


def scenario_tags(df: DataFrame, time: Column, utc_shift: int = 8) -> DataFrame:
    """df once for each overlapping group of its row: All, Day (06-18 local) or Night, and the season."""
    local = time + F.expr(f"interval {utc_shift} hours")
    hour, month = F.hour(local), F.month(local)
    tags = F.array(F.lit("All"), F.when(hour.between(6, 17), "Day").when(hour.isNotNull(), "Night"), season(month))
    return df.withColumn("scenario", F.explode(F.filter(tags, lambda x: x.isNotNull())))


#: Metrics of which less is better; others are better when higher (fixed values).
LOWER_IS_BETTER = ("fog_far", "mist_far", "clear_far", "low_vis_far", "low_vis_fpr", "multiclass_brier", "low_vis_brier", "ece_multiclass", "ece_low_vis", "ece")


def metric_delta(table: DataFrame, left: str, right: str, names: Sequence[str]) -> DataFrame:
    """metric, left, right, delta, lower_is_better, left_better for two sources of a metric table."""
    long = table.select("source", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("source", "m.*")
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    both = long.groupBy("metric").agg(pick(left).alias("left"), pick(right).alias("right"))
    both = both.withColumns({"delta": F.col("left") - F.col("right"), "lower_is_better": F.col("metric").isin(*LOWER_IS_BETTER)})
    return both.withColumn("left_better", F.when(F.col("lower_is_better"), F.col("delta") < 0).otherwise(F.col("delta") > 0))


def win_loss(pairs: DataFrame) -> DataFrame:
    """pairs (y_cls, a_pred, b_pred) with a_wins, b_wins."""
    a, b = F.col("a_pred") == F.col("y_cls"), F.col("b_pred") == F.col("y_cls")
    return pairs.withColumns({"a_wins": a & ~b, "b_wins": b & ~a})


def daily_event_stats(df: DataFrame, day: Column, by: Sequence[str] = ("source",)) -> DataFrame:
    """Per date tp, fp, fn, tn of low visibility, sum of squared errors and rows."""
    y, p = F.col("y_cls") <= 1, F.col("pred") <= 1
    error = F.pow(F.col("p_fog") + F.col("p_mist") - y.cast("double"), 2.0)
    return df.groupBy(*by, day.alias("day")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.sum(error).alias("sq_error"), F.count("*").alias("n"),
    )


def class_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    rate = lambda i: F.count_if(F.col("y_cls") == i) / F.count("*")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("y_cls") == i).alias(f"n_{c}") for i, c in enumerate(CLASSES)],
        *[rate(i).alias(f"rate_{c}") for i, c in enumerate(CLASSES)],
    )
    return with_quantiles(out, df, by, {"v": F.col("vis_m")}, {"vis_p50": ("v", 0.5), "vis_p90": ("v", 0.9)})


def extreme_contingency(pairs: DataFrame, month: str, value: str, reference: str, level: float, own_quantile: bool = False) -> DataFrame:
    """POD, FAR, CSI, ETS, frequency bias and SEDI (Ferro and Stephenson 2011) of tail events, by source.

    pairs has a row a source and sample with its value and the reference's; an event of the reference is over
    its monthly quantile, one of the source over the same (or its own) quantile.
    """
    per = exact_quantiles(pairs, ["source", month], {"own": F.col(value), "ref": F.col(reference)}, {"_own": ("own", level), "_ref": ("ref", level)})
    both = pairs.join(per, ["source", month])
    event, call = F.col(reference) > F.col("_ref"), F.col(value) > (F.col("_own") if own_quantile else F.col("_ref"))
    n = both.groupBy("source").agg(
        F.count_if(event & call).alias("a"), F.count_if(~event & call).alias("b"), F.count_if(event & ~call).alias("c"), F.count_if(~event & ~call).alias("d")
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    chance = F.try_divide((a + b) * (a + c), a + b + c + d)
    h, f = ratio(a, a + c), ratio(b, b + d)
    inside = (h > 0) & (h < 1) & (f > 0) & (f < 1)
    guarded = lambda x: F.log(F.when(inside, x))
    lf, lh, l1f, l1h = guarded(f), guarded(h), guarded(F.lit(1.0) - f), guarded(F.lit(1.0) - h)
    return n.select(
        "source", ratio(a, a + c).alias("pod"), ratio(b, a + b).alias("far"), ratio(a, a + b + c).alias("csi"),
        ratio(a - chance, a + b + c - chance).alias("ets"), ratio(a + b, a + c).alias("bias"),
        F.try_divide(lf - lh - l1f + l1h, lf + lh + l1f + l1h).alias("sedi"),
    )


def distribution_table(df: DataFrame, value: Column, by: Sequence[str], low: float, high: float, bins: int) -> tuple[DataFrame, DataFrame]:
    """Quantiles (p50, p90, p95, p99) and a histogram of value by group."""
    rows = df.select(*by, value.alias("_v")).filter(F.col("_v").isNotNull())
    quantiles = banded_quantiles(rows, "_v", by)
    place = F.least(F.floor((F.col("_v") - low) / ((high - low) / bins)), F.lit(bins - 1))
    inside = rows.filter(F.col("_v").between(low, high)).withColumn("bin", place)
    return quantiles, inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def elevation_bands(df: DataFrame, elevation: Column) -> DataFrame:
    """df once as band `all` and once as its own band: <100, 100-500, >=500 m."""
    own = F.when(elevation < 100, "<100").when(elevation < 500, "100-500").when(elevation.isNotNull(), ">=500")
    return df.withColumn("band", F.explode(F.filter(F.array(F.lit("all"), own), lambda x: x.isNotNull())))


def paired_error_metrics(df: DataFrame, by: Sequence[str], value: str, reference: str) -> DataFrame:
    """Bias, MAE, RMSE, correlation, P95 of both and their difference, against the reference."""
    d = F.col(value) - F.col(reference)
    df = df.filter(F.col(value).isNotNull() & F.col(reference).isNotNull())
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.corr(value, reference).alias("r"),
    )
    out = with_quantiles(out, df, by, {"v": F.col(value), "r": F.col(reference)}, {"p95": ("v", 0.95), "ref_p95": ("r", 0.95)})
    return out.withColumn("p95_delta", F.col("p95") - F.col("ref_p95"))


def mean_ensemble(df: DataFrame, members: Sequence[str], key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean probabilities of the keys that all members have, re-normalised, with y_cls and the argmax class.

    The result fails on a member without a probability and on probabilities whose sum isn't above 0."""
    held = [F.max((F.col("source") == m).cast("int")) for m in dict.fromkeys(members)]  # a distinct count would aggregate twice as often
    some = df.filter(F.col("source").isin(*members)).groupBy(*key).agg(
        reduce(lambda a, b: a + b, held).alias("_n"), F.min("y_cls").alias("y_cls"), *[F.avg(p).alias(f"_{p}") for p in PROBS],
        F.count_if(reduce(lambda a, b: a | b, [F.col(p).isNull() | F.isnan(p) for p in PROBS])).alias("_bad"),
    )
    total = reduce(lambda a, b: a + b, [F.col(f"_{p}") for p in PROBS])
    ok = F.assert_true((F.col("_bad") == 0) & (total > 0), F.lit("a member's probabilities are missing or sum to 0"))
    some = some.filter(F.col("_n") == len(members)).withColumns({"_total": total, "_ok": ok})
    return with_pred(some.select(*key, "y_cls", *[F.coalesce(F.col("_ok").cast("double"), F.col(f"_{p}") / F.col("_total")).alias(p) for p in PROBS]))


def banded_quantiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, by, {"v": F.col(value)}, {f"p{q}": ("v", q / 100) for q in (50, 90, 95, 99)})


def fit_temperature(df: DataFrame, rounds: int = 3, points: int = 21, low: float = 0.05, high: float = 20.0) -> float:
    """T in [low, high] with the least cross-entropy of softmax(log p / T): a geometric grid, refined rounds - 1 times."""
    logs = [F.log(F.greatest(F.col(p), F.lit(1e-12))) for p in PROBS]
    base = df.select(F.array(*logs).alias("z"), F.get(F.array(*logs), F.col("y_cls")).alias("zy"))
    best = low
    for _ in range(rounds):
        step = (high / low) ** (1 / (points - 1))
        grid = [low * step**i for i in range(points)]
        best = temperature_losses(base, grid).agg(F.min_by("t", F.struct("loss", "t"))).first()[0]
        low, high = max(0.05, best / step), min(20.0, best * step)
    return best


def temperature_losses(base: DataFrame, grid: Sequence[float]) -> DataFrame:
    """t, loss over base (z, zy): one pass, a sum for each t, no row a temperature."""
    loss = lambda t: F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x / t))) - F.col("zy") / t)
    sums = base.agg(*[loss(t).alias(f"_{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"_{i}").alias("loss")) for i, t in enumerate(grid)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
