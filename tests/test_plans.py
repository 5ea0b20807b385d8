"""Plans of queries: what would grow with the input in one task, or run without being compiled."""

import pytest
from pyspark.sql import functions as F

from hazeline import registry
from hazeline.operators import align, verify
from hazeline.plans import align as plans
from hazeline.views import Data

SMALL = "/root/testdata/sf0.001"


def test_fog_features_generate_no_method_that_hotspot_leaves_uncompiled(spark):
    """With Spark's default limit the one method of all features has over 8,000 bytes and is interpreted."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        registry.queries()["g1_fog_features_native"](spark, SMALL)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "6000")  # made by hand
        registry.queries()["g1_fog_features_native"](spark, SMALL)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "6000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_scatter_fields_counts_repeated_slots_once_and_aggregates_once(spark):
    """a pivot aggregates twice, by keys and variable first."""
    from hazeline.operators.normalise import scatter_fields

    rows = [(1, "T", 1.5), (1, "T", 2.5), (1, "R", None), (2, "R", -1.0), (2, "other", 9.0)]
    out = scatter_fields(spark.createDataFrame(rows, "k int, variable string, value double"), ["k"], ["T", "R"])
    assert {r["k"]: (r["T"], r["R"]) for r in out.collect()} == {1: (2.5, 0.0), 2: (0.0, -1.0)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate(") == 2  # before the shuffle and after it


def _broadcasts(df):
    """The parts of the final plan that were broadcast, each down to its shuffles."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i] or "ShuffleQueryStage" in lines[j]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_nearest_cells_are_not_found_by_broadcasting_exploded_boxes(spark):
    """180 rows a station were broadcast, 2 GB at 60 times sf0.1."""
    stations = spark.range(40).selectExpr("id as station_id", "18.0 + id % 7 as lat", "75.0 + id % 11 as lon")
    grid = spark.range(400).selectExpr("cast(id div 20 as int) as gi", "cast(id % 20 as int) as gj", "17.0 + id div 20 as lat", "74.0 + id % 20 as lon")
    weights = align.knn_weights(stations, grid)
    assert weights.count() == 160
    assert not [x for x in _broadcasts(weights) if "explode(transform" in x]


def test_the_field_is_not_moved_to_meet_the_weights(spark):
    """the field was made in one task, shuffled and sorted by cell."""
    v = Data(spark, SMALL)
    plan = align.idw_knn(align.knn_weights(v.v_station, v.v_grid), plans._field(v), ["t"], "x")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "CartesianProduct" not in plan
    assert plans._field(v).rdd.getNumPartitions() == v.tasks


def test_donor_swap_moves_no_window(spark):
    """windows of both series were shuffled and sorted to meet, and swapped step by step by lambdas, which aren't compiled."""
    out = registry.queries()["e18_donor_swap"](spark, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "lambda" not in plan
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
            assert not [x for x in below if "collect_list" in x]


def test_donor_swap_takes_windows_that_both_series_have(spark):
    base = spark.createDataFrame([(1, h, float(h), -1.0) for h in range(6)], "station_id int, h int, a double, b double")
    donor = spark.createDataFrame([(1, h, 100.0 + h, None) for h in range(6) if h != 4], "station_id int, h int, a double, b double")
    got = {(r.h, r.variant): (r.a, r.b) for r in align.donor_swap(base, donor, ["a", "b"], n=3).collect()}
    own = {h: [h - 2.0, h - 1.0, float(h)] for h in (2, 3)}
    want = {}
    for h, x in own.items():
        other = [100 + y for y in x]
        want |= {(h, "a"): (other, [-1.0] * 3), (h, "b"): (x, [None] * 3), (h, "all"): (other, [None] * 3)}
    assert got == want


def test_aligned_rows_are_moved_once(spark):
    """F32: rows were dealt by ranges, written, counted by key and occurrence and joined, with all their columns."""
    out = registry.queries()["e9_align_to_reference"](spark, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_keys_of_many_and_few_rows_are_aligned_alike(spark, monkeypatch):
    """Null keys meet none, a source that is null counts for none, occurrences beyond the shortest source go."""
    rows = [(s, k, i) for k, sizes in {"hot": (50, 40, 45), "one": (2, 1, 3), "two": (1, 1, 0), None: (1, 1, 1)}.items() for s, n in zip("ABC", sizes) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, "one", 0), (None, "two", 0)], "source string, k string, i int")
    found = {}
    for limit in (20, 20_000):
        monkeypatch.setattr(align, "IN_TASK", limit)
        found[limit] = sorted((r.k, r.source or "", r.occ, r.i) for r in align.align_to_reference(df, "B", ["k"], ["i"], 3).collect())
    assert found[20] == found[20_000]
    assert found[20] == sorted([("hot", s, i, i) for s in "ABC" for i in range(40)] + [("one", s, 0, 0) for s in ("", "A", "B", "C")])


def test_members_of_an_ensemble_are_aggregated_once(spark):
    """a distinct count of sources aggregates by key and source, then by key, on two shuffles."""
    rows = [("A", 1), ("B", 1), ("A", 2), ("A", 2), ("C", 2), ("B", 3), ("C", 3), ("A", 4), ("B", 4), ("B", 4), (None, 4)]
    df = spark.createDataFrame(rows, "source string, sample_id int").selectExpr("*", "1 as y_cls", "0.5 as p_fog", "0.25 as p_mist", "0.25 as p_clear")
    out = verify.mean_ensemble(df, ["A", "B"])
    assert sorted(r.sample_id for r in out.collect()) == [1, 4]
    assert verify.mean_ensemble(df, ["A", "B", "C"]).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Aggregate(") == 2 and plan.count("Exchange") == 1


def test_repeated_predictions_fail_and_are_not_dropped(spark):
    """the query dropped repeats, which its SQL keeps, by an aggregation of whole rows before the check for them."""
    with pytest.raises(Exception, match="key occurs 2 times"):
        registry.queries()["a7_read_predictions"](spark, SMALL).collect()
    plan = registry.queries()["a7_read_predictions"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["d9_derive_fields", "a2_concat_time", "b12_pack_row", "f1_sliding_window"])
def test_rows_of_the_series_are_dealt_to_tasks(spark, name):
    """stations were merged into one task, which made and held all hours of the series."""
    assert registry.queries()[name](spark, SMALL).rdd.getNumPartitions() >= Data(spark, SMALL).tasks


def test_keys_of_the_series_are_dealt_to_tasks_before_they_are_counted(spark):
    """F16: one task made and aggregated the keys of all hours."""
    v = Data(spark, SMALL)
    spark.sparkContext.setJobGroup("F16", "a2_duplicate_times")
    try:
        registry.queries()["a2_duplicate_times"](spark, SMALL).collect()
    finally:
        spark.sparkContext.setJobGroup("", "")
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("F16") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= v.tasks


@pytest.mark.parametrize("name", ["b11_model_input", "i15_class_distribution"])
def test_rows_are_not_moved_to_meet_the_quantiles_of_their_group(spark, name):
    """all rows were shuffled by a few groups, one task a group, to meet the brackets and the quantiles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that no join is broadcast because its input is small here
        out = registry.queries()[name](spark, SMALL)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_paired_rows_are_moved_once(spark):
    """the table was counted by key and source, then by key, and joined to the counts; the check read it a third time."""
    out = registry.queries()["e7_paired_intersection"](spark, SMALL)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_COL") == 2  # once as the reused one


def test_keys_that_are_null_or_of_many_rows_are_paired_alike(spark):
    df = spark.createDataFrame([("A", "1-2", 1), ("A", "1-2", 2), ("B", "1-2", 3), (None, "1-2", 4), ("A", "x", 5), ("B", "y", 6), ("A", None, 7), ("B", None, 8)], "source string, k string, i int")
    assert sorted(r.i for r in align.paired_intersection(df, ["k"], 2).collect()) == [1, 2, 3, 4]


def test_stations_at_one_place_are_searched_once(spark, monkeypatch):
    """cells were searched, joined and ranked for each station and time, also where many stations share a place."""
    searched = []
    inner = align._idw_of_places
    monkeypatch.setattr(align, "_idw_of_places", lambda stations, *rest: searched.append(stations.count()) or inner(stations, *rest))
    grid = spark.range(64).selectExpr("cast(id div 8 as int) as gi", "cast(id % 8 as int) as gj", "cast(id div 8 as double) as lat", "cast(id % 8 as double) as lon")
    field = grid.select("gi", "gj").crossJoin(spark.range(3).select(F.col("id").alias("t"))).withColumn("x", F.when((F.col("gi") + F.col("gj") + F.col("t")) % 3 > 0, F.col("gi") * 10.0 + F.col("gj")))
    stations = spark.range(40).selectExpr("id as station_id", "cast(id % 4 as double) + 0.25 as lat", "id % 2 + 0.5 as lon")
    out = {(r.t, r.station_id): r.x for r in align.idw_radius(stations, grid, field, ["t"], "x").collect()}
    assert searched == [4] and len(out) == 120
    assert all(x == out[t, s % 4] for (t, s), x in out.items())
    alone = {(r.t, r.station_id): r.x for r in align.idw_radius(stations.filter("station_id < 4"), grid, field, ["t"], "x").collect()}
    assert all(out[k] == pytest.approx(x) for k, x in alone.items())
