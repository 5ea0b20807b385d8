"""Donors of large and small strata against plain loops, and what their plans move."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hazeline import registry
from hazeline.functions.packing import packed, unpacked
from hazeline.operators import resample, splits

SMALL = "/root/testdata/sf0.001"


def place(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16), key


def loops(rows, seed):
    """key -> donor; rows: (stratum, key)."""
    strata = defaultdict(list)
    for s, k in rows:
        strata[s].append(k)
    return {k: d for ks in strata.values() for k, d in zip(sorted(ks, key=lambda k: place("order", k)), sorted(ks, key=lambda k: place(seed, k)), strict=True)}


def test_packed_texts_are_themselves(spark):
    texts = ["", "-", "1", "12-3", "0012-", "F", "1F", "12a", "1.5", "١", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("p")).select("*", unpacked(F.col("p")).alias("u"), F.col("p.digits").isNotNull().alias("d"))
    rows = df.collect()
    assert [r.u for r in rows] == texts
    assert [r.t for r in rows if r.d] == ["", "-", "1", "12-3", "0012-"]


def test_strata_of_many_chunks_are_permuted_on_one_shuffle(spark, monkeypatch):
    """Both ranks were prefix sums; all rows were shuffled for each and again to meet by rank, with their draws."""
    monkeypatch.setattr(splits, "IN_MEMORY", 100)
    df = spark.range(3000).selectExpr("concat(id, '-', id % 7) as k", "case when id < 2500 then 'a' when id < 2950 then 'b' else 'c' end as s").repartition(5)
    out = splits.donors(df, "k", "5", ["s"])
    rows = out.collect()
    assert len(rows) == 3000
    assert {r.k: r.donor for r in rows} == loops([(r.s, r.k) for r in df.collect()], "5")
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and "SortMergeJoin" not in plan  # of small and of large strata


def test_draws_that_are_equal_are_placed_by_key(spark, monkeypatch):
    """All rows of a bucket are in one chunk, however many: here one draw has all rows."""
    monkeypatch.setattr(splits, "IN_MEMORY", 50)
    monkeypatch.setattr(splits, "draw", lambda *parts: F.lit(7).cast("long"))
    monkeypatch.setattr(splits, "_place", lambda seed, key: F.lit("00000007"))
    rows = splits.donors(spark.range(300).selectExpr("cast(id as string) as k", "1 as s"), "k", "5", ["s"]).collect()
    assert sorted(r.k for r in rows) == sorted(map(str, range(300))) and all(r.k == r.donor for r in rows)


@pytest.mark.parametrize("limit", [30, 100_000])
def test_rows_alone_are_permuted_in_their_coarse_stratum(spark, monkeypatch, limit):
    """strata of both levels, each with some over the limit."""
    monkeypatch.setattr(splits, "IN_MEMORY", limit)
    df = spark.range(900).selectExpr("concat(id, '-x') as k", "case when id < 300 then 0 when id < 500 then id div 5 else id end as f", "case when id = 899 then 5 else id % 2 end as c")
    got = {r.k: (r.donor, r.level) for r in splits.stratified_donors(df, "k", "9", ["f"], ["c"]).collect()}
    rows, n = df.collect(), defaultdict(int)
    for r in rows:
        n[r.f] += 1
    alone = [r for r in rows if n[r.f] == 1]
    want = {k: (d, "fine") for k, d in loops([(r.f, r.k) for r in rows if n[r.f] > 1], "9").items()}
    want |= {k: (d, "none" if k == "899-x" else "coarse") for k, d in loops([(r.c, r.k) for r in alone], "9").items()}
    assert got == want


@pytest.mark.parametrize("name", ["h7_marginal_donor", "h8_stratified_donor", "h8_survey_strata"])
def test_donors_move_no_row_to_meet_its_donor(spark, monkeypatch, name):
    """Rows were sorted by both ranks and joined by rank where a stratum is large."""
    monkeypatch.setattr(splits, "IN_MEMORY", 200)
    out = registry.queries()[name](spark, SMALL)
    assert out.count() > 10_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "_q" not in plan


@pytest.mark.parametrize("repeated", [False, True])
def test_permuted_values_are_those_that_joins_by_key_give(spark, repeated):
    """donors of all modes and repeats were written and joined twice by key; keys of several rows too."""
    df = spark.range(40).selectExpr("'A' as source", "cast(id as string) as k", "cast(id % 3 as int) as day", "cast(id % 3 as int) as y_cls", "id * 1.0 as x", "id % 4 as f", "id % 2 as c")
    if repeated:
        df = df.union(spark.sql("select 'A', '7', 1, 0, 99.0, 1L, 1L"))
    groups, strata = {"x": ["x"]}, {"": (["f"], ["c"])}
    score = lambda d: resample.linear_scores(d, ["x"], [[0, 0.5], [8, 0], [0, 0.25]])
    out = resample.seeded_importance(df, score, "k", groups, "r", 2, strata)
    want = resample.permutation_importance(df.drop("f", "c"), score, "k", groups, splits.donor_table(df, "k", "r", 2, by=["source"], strata=strata))
    key = lambda d: sorted((r.feature, r.mode, r.rep, r.day, r.tp, r.fp, r.fn, r.n) for r in d.collect())
    assert key(out) == key(want)
    if not repeated:
        assert "Join [k" not in out._jdf.queryExecution().executedPlan().toString()
