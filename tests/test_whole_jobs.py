"""Queries work on all rows of their input."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline import registry
from hazeline.operators import align as joins
from hazeline.operators import series, splits
from hazeline.operators.units import _with_quantile
from hazeline.plans import align, audit, ingest, resample
from hazeline.views import Data

SMALL = "/root/testdata/sf0.001"


def test_inputs_of_joins_and_files_keep_all_rows(spark):
    v = Data(spark, SMALL)
    n = v.v_field.count()
    assert [v.sql(x).count() for x in (align._L, align._R, align._RUNS, audit._FILES)] == [n] * 4
    assert v.sql(ingest._FILES).count() == v.table("orders").count()


def test_asof_input_has_ties_and_gaps(spark):
    out = registry.queries()["e1_asof_nearest"](spark, SMALL).select("t", "match").distinct().collect()
    right = {r["t"] for r in Data(spark, SMALL).sql(align._R).select("t").distinct().collect()}
    near = {r["t"]: sorted((abs(x - r["t"]), -x) for x in right if abs(x - r["t"]) <= 90) for r in out}
    assert {r["t"]: r["match"] for r in out} == {t: -c[0][1] if c else None for t, c in near.items()}
    assert any(len(c) > 1 and c[0][0] == c[1][0] for c in near.values()) and not all(near.values())


def test_donor_swap_covers_every_complete_window(spark):
    field = defaultdict(dict)
    for r in Data(spark, SMALL).v_met.select("station_id", "h", "u10", "v10").collect():
        field[r["station_id"]][r["h"]] = (r["u10"], r["v10"])
    want = {}
    for s, at in field.items():
        for h in at:
            if not all(h - k in at for k in range(12)):
                continue
            own, other = (sum((i + 1) * at[h - 11 + i][c] for i in range(12)) for c in (0, 1))
            want |= {(s, h, "u10"): (other, other), (s, h, "v10"): (own, own), (s, h, "all"): (other, own)}
    got = registry.queries()["e18_donor_swap"](spark, SMALL).collect()
    assert len(got) == len(want) > 0
    assert {(r["station_id"], r["h"], r["variant"]): (r["u"], r["v"]) for r in got} == want


def test_grid_has_a_cell_a_part_and_the_field_all_hours(spark):
    v = Data(spark, "/root/testdata/sf0.1")
    g = v.v_grid.agg(F.count("*").alias("n"), F.count_distinct("gi", "gj").alias("k"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert g[0] == g[1] == v.table("part").count() > 2000
    assert 17 == g[2] and g[3] < 47 and 74 == g[4] and g[5] < 130.25
    assert v.v_grid.agg(F.count_distinct("gi") * F.count_distinct("gj")).first()[0] == g[0]
    assert registry.queries()["d10_static_features"](spark, v.dir).count() == v.v_station.count()
    small = Data(spark, SMALL)
    assert small.sql(align._GF).count() == small.v_grid.count() * small.v_spine.select("h").distinct().count()


def test_idw_radius_looks_past_missing_near_cells(spark):
    """k = 2: the 4 nearest cells lack values at some times, so farther ones count; against brute force."""
    cells = [(i, j, i * 0.5, j * 0.5) for i in range(8) for j in range(8)]
    at = {1: (1.6, 1.7), 2: (3.1, 0.2), 3: (0.0, 0.0)}
    field = [(t, i, j, None if (i * 3 + j * 5 + t) % 8 > t else i * 10.0 + j + t) for t in range(8) for i, j, _, _ in cells]
    held = {(t, i, j): x for t, i, j, x in field if x is not None}
    grid = spark.createDataFrame(cells, "gi int, gj int, lat double, lon double")
    stations = spark.createDataFrame([(s, *p) for s, p in at.items()], "station_id int, lat double, lon double")
    got = joins.idw_radius(stations, grid, spark.createDataFrame(field, "t int, gi int, gj int, x double"), ["t"], "x", k=2, reach=3.0).collect()
    far = 0
    for r in got:
        a, b = at[r["station_id"]]
        near = sorted((math.hypot(y - a, x - b), i, j) for i, j, y, x in cells if math.hypot(y - a, x - b) <= 3)
        far += sum((r["t"], i, j) in held for _, i, j in near[:4]) < 2
        best = [(d, held[r["t"], i, j]) for d, i, j in near if (r["t"], i, j) in held][:2]
        on = [x for d, x in best if d < 0.01]
        assert r["x"] == pytest.approx(sum(on) / len(on) if on else sum(x / d**2 for d, x in best) / sum(1 / d**2 for d, _ in best))
    assert len(got) == 24 and far


def test_candidates_of_valid_cells_are_bounded_and_hold_the_nearest(spark):
    """A fine grid of which little is valid, in one corner, evenly, or not at all: within reach the nearest are among some times k."""
    rng = np.random.default_rng(1)
    n, k, reach = 120, 5, 5.0
    cells = [(i, j, i * 0.05, j * 0.05) for i in range(n) for j in range(n)]
    kinds = {0: lambda i, j: True, 1: lambda i, j: rng.random() < 0.02, 2: lambda i, j: i > 100 and j > 100, 3: lambda i, j: False, 4: lambda i, j: (i, j) == (60, 60)}
    valid = [(t, i, j, y, x) for t, ok in kinds.items() for i, j, y, x in cells if ok(i, j)]
    wanted = [(t, s, float(y), float(x)) for t in kinds for s, (y, x) in enumerate(rng.random((20, 2)) * 6)]
    df = spark.createDataFrame(valid, "t int, gi int, gj int, lat double, lon double")
    asked = spark.createDataFrame(wanted, "t int, station_id int, slat double, slon double").withColumn("least", F.lit(0.01))
    got = {}
    for r in joins._valid_candidates(asked, df, ["t"], k, reach).collect():
        got.setdefault((r.t, r.station_id), []).append((math.hypot(r.lat - r.slat, r.lon - r.slon), r.gi, r.gj))
    for t, s, a, b in wanted:
        near = sorted((math.hypot(y - a, x - b), i, j) for tt, i, j, y, x in valid if tt == t)
        near = [c for c in near if c[0] <= reach]
        found = sorted(got.get((t, s), []))
        assert found[:k] == near[:k]
        if t != 2:  # in a far corner one box holds them all
            assert len(found) <= 40 * k


def test_windows_are_of_every_complete_hour(spark):
    v = Data(spark, SMALL)
    hours = {(r[0], r[1]) for r in v.v_spine.collect()}
    whole = {(s, h) for s, h in hours if all((s, h - k) in hours for k in range(12))}
    found = registry.queries()["f1_sliding_window"](spark, SMALL).select("station_id", "h").collect()
    assert len(found) == len(whole) and {tuple(r) for r in found} == whole
    assert registry.queries()["b12_pack_row"](spark, SMALL).count() == 24 * len(whole)


def test_a_step_takes_windows_by_position(spark):
    df = spark.range(40).selectExpr("id % 2 as station_id", "id div 2 as h", "cast(id as double) as x")
    found = series.sliding_window(df, ["x"], n=4, step=3).select("station_id", "h", F.col("win.x").alias("x")).collect()
    assert sorted((r[0], r[1]) for r in found) == [(s, h) for s in (0, 1) for h in range(3, 20, 3)]
    assert all(r["x"] == [2.0 * (r["h"] - k) + r["station_id"] for k in (3, 2, 1, 0)] for r in found)


def test_bootstrap_draws_dates_a_thousand_times(spark):
    v = Data(spark, SMALL)
    dates = v.v_pred.select("valid_time").distinct().count()
    assert resample.daily_counts(v).select("day").distinct().count() == dates > 31
    assert {r[0] for r in registry.queries()["j2_bootstrap_dates"](spark, SMALL).select("n_rep").collect()} == {1000}


def test_stations_of_a_series_are_dealt_to_many_tasks(spark):
    """A few bytes of stations were merged into one task, which then held all hours of all stations."""
    held = Data(spark, "/root/testdata/sf0.01").v_field.select("station_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in held}) > 1
    assert len(held) == len({r.station_id for r in held})  # a station is in one task, so windows need no shuffle


def test_quantiles_of_few_groups_do_not_shuffle_rows(spark):
    """The rows were dealt by group to join their group's quantile, so a task held a group, or were broadcast themselves."""
    rows = spark.range(20_000).selectExpr("id % 2 as g", "cast(id as double) as x")
    out = _with_quantile(rows, ["g"], F.col("x"), 0.5, "m")
    out.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_stratified_donors_of_large_and_small_strata(spark, monkeypatch):
    """Strata over the limit are ranked by prefix sums, the others on one shuffle: the same donors, strata that are null too."""
    rows = spark.range(400).selectExpr("cast(id as string) as k", "nullif(id % 7, 3) as f", "case when id < 300 then 0 else id end as g", "id % 2 as c")
    found = {}
    for limit in (10, 20_000):
        monkeypatch.setattr(splits, "IN_MEMORY", limit)
        out = splits.stratified_donors(rows, "k", "9", ["f", "g"], ["c"])
        found[limit] = sorted(tuple(r) for r in out.collect())
    assert found[10] == found[20_000]
    assert len(found[10]) == 400 and {r[0] for r in found[10]} == {r[1] for r in found[10]}
