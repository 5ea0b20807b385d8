"""Sets of files read by wildcard, and checks that ride on the result's own shuffle."""

import pytest
from pyspark.sql import functions as F

from hazeline.functions.checks import unique
from hazeline.sources import sinks, station


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_runs_of_unlike_headers_are_one_table(spark, tmp_path):
    put(tmp_path / "a", "overall_metrics.csv", 'source,label,Fog_R,accuracy\nA,"Model, first",0.5,0.25\nB,,0.75,\n')
    put(tmp_path / "deep" / "b c", "overall_metrics.csv", "source,Fog_R,fog_pod,false_positive_rate\r\nA,0.1,0.2,0.5\r\n")
    put(tmp_path / "deep" / "b c", "other.csv", "source,fog_pod\nA,9\n")
    put(tmp_path / "merged" / "x", "overall_metrics.csv", "source,fog_pod\nA,8\n")
    put(tmp_path / "empty", "overall_metrics.csv", "source,fog_pod\n")
    out = station.read_metric_runs(spark, f"file:{tmp_path}", own=f"file:{tmp_path}/merged")
    assert set(out.columns) == {"run_dir", "source", "label", "fog_pod", "accuracy", "false_positive_rate", "low_vis_fpr"}
    rows = {(r.run_dir.removeprefix(str(tmp_path)), r.source): r for r in out.collect()}
    assert set(rows) == {("/a", "A"), ("/a", "B"), ("/deep/b c", "A")}
    assert rows["/a", "A"].label == "Model, first"
    assert rows["/a", "B"].label == "B"
    assert rows["/a", "B"].fog_pod == 0.75
    assert rows["/a", "B"].accuracy is None
    assert (rows["/deep/b c", "A"].fog_pod, rows["/deep/b c", "A"].low_vis_fpr) == (0.2, 0.5)


def test_a_wildcard_is_one_scan(spark, tmp_path):
    for i in range(30):
        put(tmp_path / f"run{i}", "overall_metrics.csv", f"source,fog_pod\nA,{i}\n")
    out = station.read_metric_runs(spark, f"{tmp_path}/run*")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert out.agg(F.sum("fog_pod")).first()[0] == sum(range(30))


def test_cycle_files_are_found_read_and_the_last_path_wins(spark, tmp_path):
    name = "XXX12311200010100001_t925.nc"
    spark.createDataFrame([(1,)], "v int").coalesce(1).write.parquet(f"{tmp_path}/a/{name}")
    spark.createDataFrame([(2, 3)], "v int, w int").coalesce(1).write.parquet(f"{tmp_path}/b/{name}")
    spark.createDataFrame([(4,)], "v int").coalesce(1).write.parquet(f"{tmp_path}/b/odd.nc")
    out = station.read_cycle_files(spark, f"{tmp_path}/*", 2024).collect()
    assert [(r.v, r.w, str(r.init_time), str(r.valid_time), r.variable) for r in out] == [(2, 3, "2024-12-31 12:00:00", "2025-01-01 00:00:00", "t925")]
    assert {r.path.removeprefix(str(tmp_path)) for r in station.file_set(spark, f"{tmp_path}/*").collect()} >= {f"/a/{name}", f"/b/{name}", "/b/odd.nc"}


def test_unequal_axes_are_rejected(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "station_id int, h int, x double")
    b = spark.createDataFrame([(1, 0, 1.0)], "station_id int, h int, y double")
    with pytest.raises(Exception, match="a variable lacks the key 1 1"):
        station.merge_variables([a, b]).collect()
    assert station.merge_variables([a, b], equal_axes=False).count() == 2
    assert station.merge_variables([a, a.withColumnRenamed("x", "z")]).filter("x = z").count() == 2


def test_a_check_reads_its_input_once(spark, tmp_path):
    spark.range(100).selectExpr("id as station_id", "id as h", "id as x").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = station.concat_time([df.filter("h < 50"), df.filter("h >= 50")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    with pytest.raises(Exception, match="key occurs 2 times: 7"):
        unique(df.union(df.filter("h = 7")), ["h"]).collect()


def test_a_source_that_repeats_a_key_fails(spark):
    rows = [("A", "k", 0, 0.5, 0.2, 0.3), ("B", "k", 1, 0.2, 0.5, 0.3), ("B", "k", 1, 0.2, 0.5, 0.3)]
    df = spark.createDataFrame(rows, "source string, sample_id string, pred int, p_fog double, p_mist double, p_clear double")
    with pytest.raises(Exception, match="a source repeats key k"):
        sinks.paired_predictions(df, ["A", "B"]).collect()
    assert sinks.paired_predictions(df.distinct(), ["A", "B"]).first().B_pred == 1


def test_stored_tables_can_be_removed(spark):
    before = len(sinks._made)
    df = sinks.stored(spark.range(3).toDF("id"), "small")
    assert df.count() == 3
    path = sinks._made[-1]
    sinks.remove_stored(spark, before)
    assert len(sinks._made) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
