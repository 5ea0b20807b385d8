"""Donors, permutation importance, bootstraps and scaled scoring against plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import align, resample, splits, verify

HOT = 20_000


def rows_of(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        xs = [[float(x) for x in rng.integers(0, 9, 12)] for _ in range(3)]
        rows.append(("AB"[i % 2], f"k{i}", int(i % 7), int(rng.integers(0, 3)), f"{2020}-{1 + i % 12:02d}-05 {i % 24:02d}:00:00", float(20 + i % 25), 100.0, *xs))
    df = spark.createDataFrame(rows, "source string, k string, day int, y_cls int, t string, lat double, lon double, Q_1000 array<double>, RH2M array<double>, T2M array<double>")
    return rows, df.withColumn("t", F.to_timestamp("t"))


GROUPS = {"Q_1000": ["Q_1000"], "RH2M": ["RH2M"], "moist": ["Q_1000", "RH2M"], "all": ["Q_1000", "RH2M", "T2M"]}


def score(df):
    return resample.linear_scores(df.withColumns({f"z{c}": F.aggregate(c, F.lit(0.0), lambda a, x: a + x) for c in ("Q_1000", "RH2M", "T2M")}), ["zQ_1000", "zRH2M", "zT2M"], [[0, 0.25, 0, 0], [0, 0, 0.25, 0], [0, 0, 0, 0.25]])


def test_anchors_leave_out_the_group():
    held = ["T2M", "rh2m", "Q_1000"]
    assert [splits.anchor_of(m, held) for m in (["RH2M"], ["Q_1000"], ["q_1000", "RH2M"], held)] == ["Q_1000", "RH2M", "T2M", None]


def test_importance_equals_plain_loops(spark):
    """Windows of 12 steps, groups and packages, marginal and stratified donors with an anchor for each group."""
    rows, df = rows_of(spark)
    anchors = {name: splits.anchor_of(cs, ["Q_1000", "RH2M", "T2M"]) for name, cs in GROUPS.items()}
    strata_of = {a or "": splits.strata_of(a) for a in set(anchors.values())}
    coded = splits.with_strata(df, "t", {a: F.element_at(a, -1) for a in ("Q_1000", "RH2M", "T2M")})
    donors = splits.donor_table(coded, "k", "r", 2, by=["source"], strata=strata_of)
    table = donors.collect()
    got = {(r.feature, r.mode, r.rep, r.source, r.day): (r.tp, r.fp, r.fn, r.n) for r in resample.permutation_importance(df.drop("t", "lat", "lon"), score, "k", GROUPS, donors, anchors=anchors).collect()}
    by_key = {r[1]: r for r in rows}
    names = ["Q_1000", "RH2M", "T2M"]
    want = defaultdict(lambda: [0, 0, 0, 0])
    for r in table:
        for feature, cs in GROUPS.items():
            if r.mode == "none" or (r.mode == "stratified" and r.anchor != (anchors[feature] or "")):
                continue
            row, donor = by_key[r.k], by_key[r.donor]
            assert row[0] == donor[0]
            count(want[feature, r.mode, r.rep, row[0], row[2]], row[3], [sum((donor if n in cs else row)[7 + i]) for i, n in enumerate(names)])
    for row in rows:
        count(want["baseline", "none", 0, row[0], row[2]], row[3], [sum(x) for x in row[7:]])
    assert got == {k: tuple(x) for k, x in want.items()}
    for mode, anchor, rep in {(r.mode, r.anchor, r.rep) for r in table}:
        mine = [r for r in table if (r.mode, r.anchor, r.rep) == (mode, anchor, rep)]
        assert sorted(r.k for r in mine) == sorted(r.donor for r in mine) == sorted(by_key)


def count(cell, y, z):
    pred = 0 if z[0] >= z[1] and z[0] >= z[2] else 1 if z[1] >= z[2] else 2
    cell[0] += y <= 1 and pred <= 1
    cell[1] += y > 1 and pred <= 1
    cell[2] += y <= 1 and pred > 1
    cell[3] += 1


def test_strata_are_those_of_the_survey(spark):
    _, df = rows_of(spark)
    out = splits.with_strata(df, "t", {"Q_1000": F.element_at("Q_1000", -1)}).collect()
    for source in "AB":
        mine = [r for r in out if r.source == source]
        edges = np.unique(np.quantile([r.Q_1000[-1] for r in mine], [0, 0.25, 0.5, 0.75, 1]))
        for r in mine:
            assert r.code_Q_1000 == np.digitize(r.Q_1000[-1], edges[1:-1], right=True)
            assert (r.season, r.hour_bin, r.lat_bin, r.lon_bin) == (r.t.month % 12 // 3, r.t.hour // 6, int(r.lat // 10), 10)


def test_drawn_sums_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows = [("AB"[i % 2], int(i % 3), int(d), int(rng.integers(1, 9)), float(rng.random())) for i in range(6) for d in range(0, 40, 1 + i % 3)]
    df = spark.createDataFrame(rows, "source string, pred int, day int, n long, sq double")
    got = {(r.rep, r.source, r.pred): (r.n, round(r.sq, 9)) for r in resample.drawn_sums(df, ["source", "pred"], ["n", "sq"], 30, "s").collect()}
    days = sorted({r[2] for r in rows})
    want = defaultdict(lambda: [0, 0.0])
    for rep in range(30):
        times = Counter(days[int(hashlib.md5(f"s|{rep}|{slot}".encode()).hexdigest()[:8], 16) % len(days)] for slot in range(len(days)))
        for source, pred, day, n, sq in rows:
            if times[day]:
                want[rep, source, pred][0] += n * times[day]
                want[rep, source, pred][1] += sq * times[day]
    assert got == {k: (n, round(sq, 9)) for k, (n, sq) in want.items()}


def test_scores_of_scaled_inputs(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y"), (3, float("nan"), "z"), (4, 1e9, "w")], "id int, a double, note string")
    scaler = spark.createDataFrame([("a", 3.0, 2.0), ("other", 0.0, 1.0)], "name string, center double, scale double")
    out = resample.batch_score(df, lambda x: np.c_[x, -x, 0 * x], ["a"], scaler=scaler)
    assert out.columns == ["id", "a", "note", "p_fog", "p_mist", "p_clear"]
    got = {r.id: np.log(r.p_fog / r.p_clear) for r in out.collect()}
    assert got == pytest.approx({1: 2 / (2 + 1e-6), 2: 0, 3: 0, 4: 10})
    with pytest.raises(Exception, match="the scaler lacks a"):
        resample.batch_score(df, lambda x: np.c_[x, x, x], ["a"], scaler=scaler.filter("name <> 'a'")).collect()


def test_a_key_may_hold_all_rows(spark, monkeypatch):
    """Occurrences of one key, ties included: it is split into ranges of like size, each with a window of its own."""
    kept = []
    store = align.stored
    monkeypatch.setattr(align, "stored", lambda df, label: kept.append(store(df, label)) or kept[-1])
    df = spark.range(0, HOT, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("t"), "id").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        got = align.with_occurrence(df, ["k"], ["t"]).orderBy("occ").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    assert max(parts) < HOT / 2
    assert [r.occ for r in got] == list(range(HOT))
    assert [r.t for r in got] == sorted(r.t for r in got)


def test_average_precision_of_many_scores_equals_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [("A", int(s), int(p)) for s, p in zip(rng.integers(0, 3000, 9000), rng.integers(0, 2, 9000), strict=True)]
    df = spark.createDataFrame(rows, "source string, s int, p int")
    got = verify.average_precision(df, F.col("s").cast("double"), F.col("p") == 1).first().ap
    pos, n = Counter(), Counter()
    for _, s, p in rows:
        pos[s] += p
        n[s] += 1
    tp = seen = total = 0
    for s in sorted(n, reverse=True):
        tp, seen = tp + pos[s], seen + n[s]
        total += pos[s] * tp / seen
    assert got == pytest.approx(total / sum(pos.values()))
