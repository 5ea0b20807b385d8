"""Golden values, properties and errors of operators."""

import math

import pytest
from pyspark.sql import functions as F

from hazeline.functions import layouts
from hazeline.operators import align, audit, normalise, resample, series, splits, units, verify
from hazeline.sources import sinks, station


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def pm(spark, xs, unit):
    return spark.createDataFrame([(i, "s", x, unit) for i, x in enumerate(xs)], "i int, source string, x double, unit string")


@pytest.mark.parametrize(
    ("xs", "unit", "want"),
    [
        ([0.0, 5e-8, 1e-7, None], "ug m-3", [0, 50, 100, None]),
        ([0.0, 50000.0, 100000.0], "legacy_mixed", [0, 50, 100]),
        ([1000.0, 5000.0, 9000.0], units.LEGACY, [1, 5, 9]),
        ([0.0, 50.0, 100.0], "ug m-3", [0, 50, 100]),
    ],
)
def test_canonicalize_pm(spark, xs, unit, want):
    got = values(units.canonicalize_pm(pm(spark, xs, unit), "x", "unit", ["source"]), "x")
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_sanitize_pm(spark):
    got = values(units.sanitize_pm(pm(spark, [20.0, 100.0, 20000.0, -999.0, None], "ug m-3"), "x", "unit", ["source"]), "x")
    assert got == [20, 100, 60, 60, 60]
    got = values(units.sanitize_pm(pm(spark, [100000.0, 2e7], units.LEGACY), "x", "unit", ["source"], fill=75.5), "x")
    assert got == [pytest.approx(100), 75.5]
    with pytest.raises(ValueError):
        units.sanitize_pm(pm(spark, [1.0], ""), "x", "unit", ["source"], fill=-1)


def long(spark, name, xs):
    return spark.createDataFrame([(i, "s", name, x) for i, x in enumerate(xs)], "i int, source string, variable string, value double")


@pytest.mark.parametrize(
    ("name", "xs", "want"),
    [
        ("MSLP", [1000.0, 1010.0], [100000, 101000]),
        ("MSLP", [100000.0, 101000.0], [100000, 101000]),
        ("Q_1000", [5.0, 10.0], [0.005, 0.01]),
        ("RH2M", [0.5, 1.0, None], [50, 100, None]),
        ("T2M", [None, None], [None, None]),
    ],
)
def test_canonicalize_units(spark, name, xs, want):
    assert values(units.canonicalize_units(long(spark, name, xs)), "value") == [w if w is None else pytest.approx(w) for w in want]


def test_pressure_of_no_known_unit_raises(spark):
    with pytest.raises(Exception, match="neither hPa nor Pa"):
        units.canonicalize_units(long(spark, "MSLP", [5.0, 6.0])).collect()


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).selectExpr("id % 7 as station_id", "cast(id / 7 as bigint) as h", "cast(id % 13 as double) as T2M", "cast(id % 5 as double) as DPD")
    a = series.fog_features_native(df.coalesce(1)).orderBy("station_id", "h").collect()
    assert a == series.fog_features_native(df.repartition(9)).orderBy("station_id", "h").collect()


def test_feature_sets():
    assert [len(layouts.feature_set(s)) for s in ("common_core", "compact", "q_core", "full", "all")] == [16, 15, 14, 21, 24]
    assert layouts.feature_set("source_full", ["DPD", "T2M"]) == ["T2M", "DPD"]
    with pytest.raises(ValueError):
        layouts.feature_set("nothing")
    assert [len(layouts.feature_set("source_full", profile=p)) for p in (None, "tianji", "ifs", "Pangu", "pangu2025")] == [24, 24, 21, 18, 16]
    assert layouts.feature_set("source_full", ["DPD", "T2M"], "pangu2025") == ["T2M"]
    with pytest.raises(ValueError, match="unknown profile"):
        layouts.feature_set("source_full", profile="nobody")


def test_packages_of_shared_variables(spark):
    rows = layouts.packages(["T2M", "Q_1000"])
    assert [m for p, m in rows if p == "shared_low_level_moisture"] == ["Q_1000"] and [m for p, m in rows if p == "shared_dynamic_all"] == ["T2M", "Q_1000"]
    available = spark.createDataFrame([("A", "T2M"), ("A", "Q_1000"), ("B", "T2M"), ("B", "Q_1000"), ("B", "D2M")], "source string, name string")
    found = resample.feature_group_manifest(available, spark.createDataFrame(rows, "package string, member string")).collect()
    got = {(r["source"], r["feature"]): (r["members"], r["kind"], r["n_columns"]) for r in found}
    assert got["A", "native_near_surface_moisture"] == ("Q_1000", "package", 12) and got["B", "native_near_surface_moisture"] == ("D2M,Q_1000", "package", 24)
    assert got["A", "shared_dynamic_all"] == ("Q_1000,T2M", "shared_package", 24) and ("A", "native_aerosol") not in got


def test_month_tail_split_keeps_gaps(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d").select("d", splits.month_tail_split(F.col("d")).alias("s"))
    found = {r["d"]: r["s"] for r in days.collect()}
    assert [found[d] for d in sorted(found)][:31] == ["train"] * 23 + [None] + ["val"] * 3 + [None] + ["test"] * 3
    with pytest.raises(ValueError):
        splits.month_tail_split(F.col("d"), gap_hours=5)


def test_donors_are_permutations(spark):
    df = spark.range(500).selectExpr("cast(id as string) as k", "id % 3 as s")
    rows = splits.donors(df, "k", "1", ["s"]).collect()
    assert sorted(r["k"] for r in rows) == sorted(r["donor"] for r in rows) == sorted(map(str, range(500)))
    assert all(int(r["k"]) % 3 == int(r["donor"]) % 3 for r in rows)
    assert sum(r["k"] != r["donor"] for r in rows) > 450


def test_class_balanced_sample_has_its_shares(spark):
    df = spark.range(300).selectExpr("cast(id as string) as k", "case when id % 10 = 0 then 0 when id % 10 = 1 then 1 else 2 end as y_cls")
    rows = splits.class_balanced_sample(df, "k", 4, 50, "2").groupBy("batch", "y_cls").count().collect()
    assert {(r["y_cls"], r["count"]) for r in rows} == {(0, 9), (1, 11), (2, 30)}


def test_idw_weights_sum_to_one_and_stay_in_range(spark):
    grid = spark.range(100).selectExpr("cast(id div 10 as int) gi", "cast(id % 10 as int) gj", "cast(id div 10 as double) lat", "id % 10 * 1.5 as lon", "cast(id as double) x")
    stations = spark.createDataFrame([(1, 3.3, 4.4), (2, 3.0, 4.5), (3, 90.0, 200.0)], "station_id int, lat double, lon double")
    w = align.knn_weights(stations, grid)
    assert all(r["s"] == pytest.approx(1) and r["n"] == 4 for r in w.groupBy("station_id").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect())
    out = {r["station_id"]: r["x"] for r in align.idw_knn(w, grid.withColumn("t", F.lit(0)), ["t"], "x").collect()}
    assert out[2] == pytest.approx(33, abs=1e-3) and 0 <= out[3] <= 99


def test_asof_takes_the_later_on_ties(spark):
    left, right = spark.createDataFrame([(100,), (500,)], "t long"), spark.createDataFrame([(40,), (160,), (300,)], "t long")
    assert [tuple(r) for r in align.asof_times(left, right, 90).collect()] == [(100, 160)]


def test_threshold_search_equals_brute_force(spark):
    rows = [(i % 3, ((i * 7) % 10 + 0.5 + 3 * (i % 3 == 0)) / 20, ((i * 3) % 7 + 0.5 + 3 * (i % 3 == 1)) / 20) for i in range(400)]
    df = spark.createDataFrame([("A", y, f, m, 1 - f - m) for y, f, m in rows], "source string, y_cls int, p_fog double, p_mist double, p_clear double")
    table = {(r["fog_i"], r["mist_i"]): r for r in verify.threshold_table(df).collect()}
    grid = verify.threshold_grid()
    for a, b in [(0, 0), (5, 12), (25, 3), (25, 25)]:
        pred = [0 if f > grid[a] and f > m else 1 if m > grid[b] and m > f else 2 for _, f, m in rows]
        hits = sum(p == y for p, (y, _, _) in zip(pred, rows, strict=True))
        assert table[a, b]["accuracy"] == pytest.approx(hits / len(rows))
        assert table[a, b]["fog_predicted"] == pred.count(0)


def test_average_precision_of_one_class_is_null(spark):
    df = spark.createDataFrame([("A", 0.1), ("A", 0.2)], "source string, s double")
    assert verify.average_precision(df, F.col("s"), F.lit(True)).first()["ap"] is None


def test_temperature_of_calibrated_scores_is_one(spark):
    rows = [(y, 0.6, 0.3, 0.1) for y, n in ((0, 60), (1, 30), (2, 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "y_cls int, p_fog double, p_mist double, p_clear double")
    assert verify.fit_temperature(df) == pytest.approx(1, abs=0.03)


def test_metrics_of_an_empty_class_are_zero(spark):
    counts = spark.createDataFrame([("A", 2, 2, 5)], "source string, y_cls int, pred int, n long")
    r = verify.metrics(counts).first()
    assert r["fog_csi"] == 0 and r["accuracy"] == 1 and r["low_vis_fpr"] == 0


def test_bootstrap_interval_holds_the_difference(spark):
    rows = [(i % 3, (i * 5 // 3) % 3, i % 3 if i % 4 else 2) for i in range(300)]
    df = spark.createDataFrame(rows, "y_cls int, a_pred int, b_pred int")
    r = resample.bootstrap_rows(df, "accuracy", n_rep=200).first()
    assert r["low"] <= r["mean"] <= r["high"] and r["low"] <= r["observed"] <= r["high"]


def test_sources_reject_what_is_ambiguous(spark):
    a = spark.createDataFrame([(1, 1, 2.0)], "station_id int, h int, x double")
    with pytest.raises(Exception, match="key occurs 2 times: 1 1"):
        station.concat_time([a, a]).collect()
    with pytest.raises(ValueError):
        station.merge_variables([a, a])
    with pytest.raises(ValueError):
        station.checked_predictions(a)
    with pytest.raises(Exception, match="station is missing: 1"):
        align.station_reindex(a, a.filter("h > 5")).collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "train", 2, 1.0), ("A", "test", 1, 2.0)], "source string, split string, valid_time int, x double")
    sinks.write_split_dataset(df, str(tmp_path / "s"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1.0, 2.0]
    sinks.write_config(spark.createDataFrame([("v2", [1, 2])], "policy string, steps array<int>"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first()["policy"] == "v2"


def test_staged_audit_stops_after_an_error(spark):
    ran = []

    def stage(name, severity):
        def make():
            ran.append(name)
            return spark.createDataFrame([(severity, name)], "severity string, message string")

        return name, make

    out = audit.staged_audit([stage("a", "warning"), stage("b", "error"), stage("c", "error")])
    assert ran == ["a", "b"] and out.count() == 2


def test_soft_labels_and_zenith(spark):
    from hazeline.functions import physics

    vs = [0.0, 400.0, 500.0, 700.0, 1000.0, 1200.0]
    df = spark.createDataFrame([(v,) for v in vs], "v double").select(physics.soft_label(F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == [[1, 0, 0], [1, 0, 0], [0.5, 0.5, 0], [0, 1, 0], [0, 0.5, 0.5], [0, 0, 1]]
    noon = spark.range(1).select(physics.solar_zenith(F.lit(80), F.lit(12.0), F.lit(0.0), F.lit(0.0)).alias("z")).first()["z"]
    assert noon < 3 and not math.isnan(noon)


def test_null_stays_null_in_clips(spark):
    from hazeline.functions.physics import clip

    assert spark.range(1).select(clip(F.lit(None).cast("double"), 0.0, 1.0).alias("x")).first()["x"] is None


def test_normalise_names(spark):
    names = [" rh925", "2D", "pm2_5", "wind"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(normalise.canonical_name(F.col("n")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["RH_925", "D2M", "PM25", "wind"]


def test_missing_probabilities_have_no_class(spark):
    rows = [("A", "k", 2, 0.2, 0.3, 0.5), ("A", "n", 2, None, 0.3, 0.5), ("A", "z", 2, float("nan"), 0.3, 0.5)]
    df = spark.createDataFrame(rows, "source string, sample_id string, y_cls int, p_fog double, p_mist double, p_clear double")
    assert {r["sample_id"]: r["pred"] for r in verify.with_pred(df).collect()} == {"k": 2, "n": None, "z": None}
    called = df.select("sample_id", verify.threshold_class([F.col(p) for p in verify.PROBS], F.lit(0.4), F.lit(0.25)).alias("c"))
    assert {r["sample_id"]: r["c"] for r in called.collect()} == {"k": 1, "n": None, "z": None}


@pytest.mark.parametrize("bad", [(None, 0.5, 0.5), (0.0, 0.0, 0.0), (float("nan"), 0.5, 0.5)])
def test_ensemble_of_missing_or_zero_probabilities_fails(spark, bad):
    rows = [("A", "k", 2, 0.2, 0.3, 0.5), ("B", "k", 2, *bad)] if bad != (0.0, 0.0, 0.0) else [("A", "k", 2, *bad), ("B", "k", 2, *bad)]
    df = spark.createDataFrame(rows, "source string, sample_id string, y_cls int, p_fog double, p_mist double, p_clear double")
    with pytest.raises(Exception, match="missing or sum to 0"):
        verify.mean_ensemble(df, ["A", "B"]).collect()
    assert verify.mean_ensemble(df, ["A", "C"]).count() == 0


def test_thresholds_of_an_ensemble_need_all_members(spark):
    found = spark.createDataFrame([("A", 0.2, 0.4), ("B", 0.4, 0.6), ("C", None, None)], "source string, fog_th double, mist_th double")
    assert [tuple(r) for r in verify.mean_thresholds(found, ["A", "B"]).collect()] == [(pytest.approx(0.3), pytest.approx(0.5))]
    with pytest.raises(Exception, match="no thresholds"):
        verify.mean_thresholds(found, ["A", "C"]).collect()


def test_no_common_key_fails(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "source string, k int")
    with pytest.raises(Exception, match="no key is common"):
        align.paired_intersection(df, ["k"], 2).collect()
    assert align.paired_intersection(df.union(df.filter("k = 1").selectExpr("'B'", "k")), ["k"], 2).count() == 2


def test_repeated_stations_fail(spark):
    df = spark.createDataFrame([(1, 30.0, 100.0), (2, 30.0, 100.0), (2, 31.0, 100.0), (3, 80.0, 100.0), (3, 81.0, 100.0)], "station_id int, lat double, lon double")
    assert normalise.station_filter(df.filter("station_id <> 2")).collect() == [(1, 30.0, 100.0)]
    with pytest.raises(Exception, match="station repeats: 2"):
        normalise.station_filter(df).collect()


def test_lead_range_is_asserted(spark):
    df = spark.createDataFrame([(12, 0, 12.0), (23, 0, None)], "valid int, init int, said double")
    leads = series.lead_evidence(df, "valid", "init", "said")
    got = series.lead_summary(leads, low=12.0, high=23.0).first()
    assert got["leads"] == {12.0: 1, 23.0: 1} and got["n_disagree"] == 0
    with pytest.raises(Exception, match="leads range from 12.0 to 23.0"):
        series.lead_summary(leads, low=12.0, high=24.0).collect()


def test_axis_with_a_gap_fails(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "h int")
    assert series.require_regular(df.filter("h < 3")).count() == 2
    with pytest.raises(Exception, match="steps by 2 to 4"):
        series.require_regular(df).collect()


def test_sample_with_few_events_fails(spark):
    df = spark.range(100).selectExpr("id", "id % 2 as s", "id < 4 as event")
    assert {tuple(r) for r in splits.uniform_sample(df, ["id"], 10, "1", by=["s"]).groupBy("s").count().collect()} == {(0, 10), (1, 10)}
    with pytest.raises(Exception, match="50 are needed"):
        splits.uniform_sample(df, ["id"], 60, "1", 50, F.col("event")).collect()


def test_moved_and_fallback_fractions(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 6 else f"g{i}", "c" if i < 8 else f"d{i}") for i in range(10)], "k string, fine string, coarse string")
    rows = splits.stratified_donors(df, "k", "4", ["fine"], ["coarse"])
    got = splits.donor_summary(rows, "k").first()
    moved = sum(r["k"] != r["donor"] for r in rows.collect())
    assert (got["n"], got["moved_fraction"], got["fallback_fraction"]) == (10, moved / 10, 0.4)


def test_lineage_names_every_fault(spark):
    schema = "dataset string, native array<string>, derived array<string>, zero_filled array<string>, unit_policy string, time_zone string, feature_order array<string>, units map<string,string>, time_step double"
    good = ("good", ["T2M", "D2M", "T_1000", "RH_1000", "U10", "V10"], ["RH2M", "Q_1000", "DP_1000", "WSPD10"], [], "v2", "UTC", ["T2M", "RH2M"], {"T2M": "K"}, 1.0)
    bad = ("bad", ["T2M", "RH_1000", "RH_925"], ["T2M", "Q_1000"], ["CAPE"], "v1", None, ["RH2M", "T2M"], {}, 3.0)
    found = audit.lineage_rules(spark.createDataFrame([good, bad], schema), "v2", ["T2M", "RH2M"], {"T2M": "K"}).collect()
    assert {r["dataset"] for r in found} == {"bad"}
    assert {r["issue"] for r in found} == {
        "native and derived: T2M", "zero-filled: CAPE", "RH_925 without T_925", "RH_1000 without T_1000", "Q_1000 derived without T_1000,RH_1000", "unit policy differs",
        "time isn't UTC", "feature order differs", "unit of T2M isn't K", "time step differs",
    }


def test_permutation_takes_whole_windows_of_the_stratum(spark):
    df = spark.createDataFrame([("A", "1", [1, 2]), ("A", "2", [3, 4]), ("B", "1", [5, 6])], "source string, k string, win array<int>")
    donors = spark.createDataFrame([("m", 1, "A", "1", "2"), ("m", 1, "A", "2", "1"), ("m", 1, "B", "1", "1"), ("none", 0, "A", "1", "1")], "mode string, rep int, source string, k string, donor string")
    got = {(r["mode"], r["feature"], r["source"], r["k"]): r["win"] for r in resample.permuted(df, donors, "k", {"w": ["win"]}, ["source"]).collect()}
    assert got == {("m", "w", "A", "1"): [3, 4], ("m", "w", "A", "2"): [1, 2], ("m", "w", "B", "1"): [5, 6], ("none", "baseline", "A", "1"): [1, 2]}


def test_importance_of_few_dates_is_empty(spark):
    rows = [("A", f, m, rep, d, 5 - rep, 1, 1, 0.5, 9) for f, m, rep in (("baseline", "none", 0), ("x", "marginal", 1)) for d in range(4)]
    daily = spark.createDataFrame(rows, "source string, feature string, mode string, rep int, day int, tp long, fp long, fn long, sq_error double, n long")
    assert resample.importance_ci(daily, 20).count() == 0
    more = daily.union(daily.withColumn("day", F.col("day") + 4))
    got = {r["metric"]: r for r in resample.importance_ci(more, 20).collect()}
    assert got["csi_drop"]["excludes_zero"] and got["csi_drop"]["mean"] == pytest.approx(5 / 7 - 4 / 6) and not got["brier_rise"]["excludes_zero"]
