"""Exact quantiles against numpy, and checks that are part of plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.functions import quantiles
from hazeline.functions.checks import described, failing
from hazeline.functions.quantiles import exact_quantiles, with_quantiles

POINTS = {"p0": 0.0, "p1": 0.001, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}


def exact(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    found = exact_quantiles(df, ["g"], {"x": F.col("x")}, {k: ("x", p) for k, p in POINTS.items()}).collect()
    return {r["g"]: [r[k] for k in POINTS] for r in found}


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 60, 977])
def test_small_groups(spark, n):
    rng = np.random.default_rng(n)
    rows = [("a", float(x)) for x in rng.normal(size=n)] + [("b", float(x)) for x in rng.integers(0, 3, n)] + [(None, 5.0), ("none", None)]
    got = exact(spark, rows, 5)
    for g in "ab":
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g], list(POINTS.values())).tolist(), rel=1e-12)
    assert got[None] == [5.0] * len(POINTS) and got["none"] == [None] * len(POINTS)


@pytest.mark.parametrize("kind", ["normal", "ties", "outliers", "sorted"])
def test_one_group_that_holds_all_rows(spark, kind):
    """Beyond what the first pass holds exactly, over many partitions, with the groups' sketches merged."""
    rng = np.random.default_rng(1)
    n = 120_000
    x = {
        "normal": rng.normal(size=n), "ties": np.repeat(rng.normal(size=40), n // 40), "outliers": np.r_[rng.normal(size=n - 30), 1e30 * rng.normal(size=30)],
        "sorted": np.sort(rng.exponential(size=n)),
    }[kind]
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": x})).repartition(23)
    got = exact_quantiles(df, [], {"x": F.col("x"), "y": -F.col("x")}, {k: ("x", p) for k, p in POINTS.items()} | {"y": ("y", 0.3)}).first()
    assert [got[k] for k in POINTS] == pytest.approx(np.quantile(x, list(POINTS.values())).tolist(), rel=1e-12)
    assert got["y"] == pytest.approx(np.quantile(-x, 0.3), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert exact_quantiles(df, ["g"], {"x": F.col("x")}, {"m": ("x", 0.5)}).count() == 0
    assert exact_quantiles(df, [], {"x": F.col("x")}, {"m": ("x", 0.5)}).collect() == [(None,)]
    out = with_quantiles(df.groupBy().agg(F.count("*").alias("n")), df, [], {"x": F.col("x")}, {"m": ("x", 0.5)})
    assert out.collect() == [(0, None)]


def test_a_fault_fails_the_result(spark):
    df = spark.range(5)
    assert failing(df, df.filter("id > 9"), "never").count() == 5
    with pytest.raises(Exception, match="found 3 of null"):
        failing(df, df.filter("id = 3"), described("found ", F.col("id"), " of ", F.lit(None))).collect()


@pytest.mark.parametrize("few, points, buckets, parts", [(1, 10, 4, 3), (1, 50, 3, 40), (100, 1000, 32, 7), (10_000, 2_000, 32, 70)])
def test_brackets_hold_the_quantiles_whatever_the_sketches_give(spark, monkeypatch, few, points, buckets, parts):
    """Groups and parts of all sizes, parts without a value, one partition that holds most rows."""
    for name, x in {"FEW": few, "POINTS": points, "BUCKETS": buckets}.items():
        monkeypatch.setattr(quantiles, name, x)
    rng = np.random.default_rng(parts)
    rows = [("one", 1.0), ("none", None), *[("ties", float(x)) for x in rng.integers(0, 4, 900)], *[("ends", x) for x in [float("-inf")] * 300 + [1.0] * 301 + [float("inf")] * 300]]
    rows += [("large", float(x)) for x in rng.normal(size=15_000)] + [("gaps", None if i % 3 else float(i)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, x double")
    df = df.filter("g <> 'large'").repartition(parts).union(df.filter("g = 'large'").coalesce(1))
    found = exact_quantiles(df, ["g"], {"x": F.col("x")}, {k: ("x", p) for k, p in POINTS.items()}).collect()
    got = {r["g"]: [r[k] for k in POINTS] for r in found}
    for g in ("one", "ties", "large", "gaps"):
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], list(POINTS.values())).tolist(), rel=1e-12)
    assert got["none"] == [None] * len(POINTS) and got["ends"] == [float("-inf")] * 3 + [1.0] + [float("inf")] * 3


def test_no_task_merges_all_sketches_of_a_group(spark):
    """a merged sketch grows with each that it takes, so one merge of all takes the square of the partitions in time."""
    df = spark.range(0, 4_000, 1, 64).select(F.rand(1).alias("x"))
    plan = exact_quantiles(df, [], {"x": F.col("x")}, {"m": ("x", 0.5)})._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "percentile_approx" in line and "keys=[" in line]
    assert keys and all("_s#" in k for k in keys)
