"""Queries of verification."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hazeline.operators import verify as V
from hazeline.registry import query

PRED = "case when p_fog>=p_mist and p_fog>=p_clear then 0 when p_mist>=p_clear then 1 else 2 end"
SCORED = f"(select *, {PRED} as pred from v_pred)"
_CELLS = ", ".join(f"count(*) filter (where y_cls={i} and pred={j}) as c{i}{j}" for i in range(3) for j in range(3))
_RATIOS = {"low_vis_precision": "coalesce(ltp/nullif(ltp+lfp,0),0)", "low_vis_pod": "coalesce(ltp/nullif(ltp+lfn,0),0)",
    "low_vis_f1": "coalesce(2*ltp/nullif(2*ltp+lfp+lfn,0),0)", "low_vis_csi": "coalesce(ltp/nullif(ltp+lfp+lfn,0),0)",
    "low_vis_far": "coalesce(lfp/nullif(ltp+lfp,0),0)", "low_vis_fpr": "coalesce(lfp/nullif(c20+c21+c22,0),0)"}


def sql_class(i: int, name: str) -> dict[str, str]:
    tp, s, p = f"c{i}{i}", "(" + "+".join(f"c{i}{j}" for j in range(3)) + ")", "(" + "+".join(f"c{j}{i}" for j in range(3)) + ")"
    return {
        f"{name}_precision": f"coalesce({tp}/nullif({p},0),0)", f"{name}_{'recall' if name == 'clear' else 'pod'}": f"coalesce({tp}/nullif({s},0),0)",
        f"{name}_f1": f"coalesce(2*{tp}/nullif({s}+{p},0),0)", f"{name}_csi": f"coalesce({tp}/nullif({s}+{p}-{tp},0),0)",
        f"{name}_far": f"coalesce(({p}-{tp})/nullif({p},0),0)", f"{name}_support": s, f"{name}_predicted": p,
    }


SQL_CLASS = {k: x for i, n in enumerate(V.CLASSES) for k, x in sql_class(i, n).items()}
SQL_ALL = SQL_CLASS | _RATIOS | {
    "n": "total", "accuracy": "(c00+c11+c22)/total", "macro_f1": "(" + "+".join(SQL_CLASS[f"{c}_f1"] for c in V.CLASSES) + ")/3",
    "weighted_f1": "(" + "+".join(f"{SQL_CLASS[f'{c}_f1']}*{SQL_CLASS[f'{c}_support']}" for c in V.CLASSES) + ")/total",
}
SQL_ALL["target_achievement"] = (
    f"least({SQL_ALL['fog_pod']}/0.65,1)*0.3+least({SQL_ALL['mist_pod']}/0.75,1)*0.3+least({SQL_ALL['accuracy']}/0.95,1)*0.25"
    f"+least({SQL_ALL['low_vis_precision']}/0.2,1)*0.1+least((1-{SQL_ALL['low_vis_fpr']})/0.6,1)*0.05"
)
COUNTS = {"n", *[f"{c}_{k}" for c in V.CLASSES for k in ("support", "predicted")]}


def sql_metrics(names: list[str], rows: str = SCORED, by: str = "source") -> str:
    cols = ", ".join(f"cast({SQL_ALL[n]} as bigint) as {n}" if n in COUNTS else f"round(cast({SQL_ALL[n]} as double),6) as {n}" for n in names)
    return f"""select {by}, {cols} from (select *, (c00+c01+c10+c11)*1.0e0 as ltp, (c20+c21)*1.0e0 as lfp, (c02+c12)*1.0e0 as lfn,
      (c00+c01+c02+c10+c11+c12+c20+c21+c22)*1.0e0 as total from (select {by}, {_CELLS} from {rows} r group by {by}) a) b"""


def sql_weighted_metrics(names: list[str], rows: str, by: str) -> str:
    """sql_metrics of rows that stand for n samples each, not rounded."""
    text = re.sub(r"count\(\*\) filter \((where y_cls=\d and pred=\d)\)", r"coalesce(sum(n) filter (\1),0)", sql_metrics(names, rows, by))
    return text.replace("round(cast(", "(cast(").replace(" as double),6)", " as double))")


def rounded(df, names, by=("source",)):
    return df.select(*by, *[F.col(n).cast("long").alias(n) if n in COUNTS else F.round(n, 6).alias(n) for n in names])


def scored(v):
    return V.with_pred(v.v_pred)


_NAMES = {"i2_class_metrics": list(SQL_CLASS), "i3_summary_metrics": ["n", "accuracy", "macro_f1", "weighted_f1"],
    "i4_event_metrics": list(_RATIOS), "i8_target_achievement": ["target_achievement"]}
for _name, _cols in _NAMES.items():
    query(_name, sql_metrics(_cols))(lambda v, cols=_cols: rounded(V.metrics(V.confusion_matrix(scored(v))), cols))


@query("i1_confusion_matrix", f"select source, y_cls, pred, count(*) as n from {SCORED} s group by 1,2,3")
def confusion(v):
    return V.confusion_matrix(scored(v))


@query("i5_brier", """select source,
  round(avg(pow(p_fog-case when y_cls=0 then 1 else 0 end,2)+pow(p_mist-case when y_cls=1 then 1 else 0 end,2)+pow(p_clear-case when y_cls=2 then 1 else 0 end,2)),6) as multiclass_brier,
  round(avg(pow(p_fog+p_mist-case when y_cls<=1 then 1 else 0 end,2)),6) as low_vis_brier from v_pred group by source""")
def brier(v):
    return V.brier(v.v_pred).select("source", *[F.round(c, 6).alias(c) for c in ("multiclass_brier", "low_vis_brier")])


@query("i6_ece", """
with b as (select source, p_fog+p_mist as s, case when y_cls<=1 then 1.0e0 else 0.0e0 end as o from v_pred),
g as (select source, least(floor(s*15),14) as k, count(*) as n, avg(s) as s, avg(o) as o from b group by 1,2)
select source, round(sum(n*abs(s-o))/sum(n),6) as ece from g group by source""")
def ece(v):
    low = F.col("p_fog") + F.col("p_mist")
    return V.expected_calibration_error(v.v_pred, low, (F.col("y_cls") <= 1).cast("double")).select("source", F.round("ece", 6).alias("ece"))


@query("i6_ece_multiclass", f"""
with b as (select source, greatest(p_fog,p_mist,p_clear) as s, case when pred=y_cls then 1.0e0 else 0.0e0 end as o from {SCORED} p),
g as (select source, least(floor(s*15),14) as k, count(*) as n, avg(s) as s, avg(o) as o from b group by 1,2)
select source, round(sum(n*abs(s-o))/sum(n),6) as ece from g group by source""")
def ece_multiclass(v):
    hit = (F.col("pred") == F.col("y_cls")).cast("double")
    return V.expected_calibration_error(scored(v), F.greatest(*V.PROBS), hit).select("source", F.round("ece", 6).alias("ece"))


_EVENTS = {"fog": ("p_fog", "y_cls=0"), "mist": ("p_mist", "y_cls=1"), "low_vis": ("p_fog+p_mist", "y_cls<=1")}


def _ap_sql(score: str, event: str) -> str:
    return f"""with s as (select source, {score} as s, sum(case when {event} then 1 else 0 end) as pos, count(*) as n from v_pred group by 1,2),
c as (select *, sum(pos) over w as tp, sum(n) over w as seen from s window w as (partition by source order by s desc))
select source, round(sum(pos*tp/seen)/sum(pos),6) as ap from c group by source"""


for _event, (_score, _is) in _EVENTS.items():
    query("i7_average_precision" if _event == "fog" else f"i7_average_precision_{_event}", _ap_sql(_score, _is))(
        lambda v, score=_score, event=_is: V.average_precision(v.v_pred, F.expr(score), F.expr(event)).select("source", F.round("ap", 6).alias("ap"))
    )


@query("i9_threshold_decision", f"""
select source, sample_id, {PRED} as by_argmax, case when p_fog>0.4e0 and p_fog>p_mist then 0 when p_mist>0.3e0 and p_mist>p_fog then 1 else 2 end as by_threshold from v_pred""")
def decision(v):
    p = [F.col(c) for c in V.PROBS]
    return v.v_pred.select("source", "sample_id", V.argmax_class(p).alias("by_argmax"), V.threshold_class(p, F.lit(0.4), F.lit(0.3)).alias("by_threshold"))


def _grid_sql(grid: list[float], rows: str, by: str, names: tuple[str, ...] = ("fog_precision", "mist_precision", "clear_recall", "mist_pod", "target_achievement")) -> str:
    """Brute force: every distinct row, with its number, against every pair of thresholds."""
    points = f"(select i-1 as i, g from (select unnest([{', '.join(repr(g) for g in grid)}]) as g, unnest(range(1,{len(grid) + 1})) as i))"
    called = f"""(select {by}, y_cls, n, f.i as fog_i, m.i as mist_i, case when p_fog>f.g and p_fog>p_mist then 0 when p_mist>m.g and p_mist>p_fog then 1 else 2 end as pred
      from (select {by}, y_cls, p_fog, p_mist, count(*) as n from {rows} q group by all) r cross join {points} f cross join {points} m)"""
    return sql_weighted_metrics(list(names), called, f"{by}, fog_i, mist_i")


_BEST = "row_number() over (partition by {by} order by {s} desc, fog_i, mist_i)"


@query("i10_threshold_search", f"""
with t as ({_grid_sql(V.threshold_grid(), "v_pred", "source")}),
strict as (select * from (select *, round(target_achievement,12) as score, 'strict' as stage, {_BEST.format(by="source", s="round(target_achievement,12)")} as k from t
  where fog_precision>=0.1 and mist_precision>=0.1 and clear_recall>=0.9) where k=1),
pen as (select *, round(target_achievement-greatest(0.1-fog_precision,0)-greatest(0.1-mist_precision,0),12) as score from t
  where fog_precision>=0.05 and mist_precision>=0.05 and clear_recall>=0.88),
relaxed as (select * from (select *, 'relaxed' as stage, {_BEST.format(by="source", s="score")} as k from pen where source not in (select source from strict)) where k=1),
best as (select source, fog_i, mist_i, score, stage from strict union all select source, fog_i, mist_i, score, stage from relaxed),
g as (select [{", ".join(repr(g) for g in V.threshold_grid())}] as g)
select s.source, round(g[cast(fog_i+1 as int)],6) as fog_th, round(g[cast(mist_i+1 as int)],6) as mist_th, round(score,6) as score, coalesce(stage,'argmax') as stage
from (select distinct source from v_pred) s cross join g left join best b on s.source=b.source""")
def search(v):
    found = V.threshold_search(v.v_pred)
    return found.select("source", *[F.round(c, 6).alias(c) for c in ("fog_th", "mist_th", "score")], "stage")


_RESPONSE = f"""with t as ({_grid_sql(V.threshold_grid("response"), "v_pred", "source", ("fog_pod", "mist_pod", "low_vis_csi", "low_vis_precision", "low_vis_fpr", "fog_predicted", "mist_predicted"))}),
k as (select *, round(fog_pod*0.3+mist_pod*0.3+low_vis_csi*0.25+low_vis_precision*0.15-low_vis_fpr*0.1,12) as score from t where fog_predicted+mist_predicted>0),
b as (select * from (select *, {_BEST.format(by="source", s="score")} as r from k) x where r=1),
g as (select [{", ".join(repr(g) for g in V.threshold_grid("response"))}] as g)
select s.source, round(g[cast(fog_i+1 as int)],6) as fog_th, round(g[cast(mist_i+1 as int)],6) as mist_th, round(score,6) as score, case when score is null then 'argmax' else 'response' end as stage
from (select distinct source from v_pred) s cross join g left join b on s.source=b.source"""


@query("i10_threshold_search_response", _RESPONSE)
def response(v):
    found = V.threshold_search(v.v_pred, policy="response")
    return found.select("source", *[F.round(c, 6).alias(c) for c in ("fog_th", "mist_th", "score")], "stage")


_SEASONED = "(select *, case when month(valid_time) in (12,1,2) then 'DJF' when month(valid_time)<=5 then 'MAM' when month(valid_time)<=8 then 'JJA' else 'SON' end as season from v_pred)"


@query("i11_season_threshold_search", f"""
with t as ({_grid_sql(V.SEASON_GRID, _SEASONED, "source, season")}),
w as ({_grid_sql(V.SEASON_GRID, "v_pred", "source")}),
ok as (select source, season from {_SEASONED} s group by source, season having count(*)>=50),
strict as (select * from (select *, 'seasonal_strict' as origin, {_BEST.format(by="source, season", s="round(target_achievement,12)")} as k from t
  where fog_precision>=0.05 and mist_precision>=0.2 and mist_pod>=0.08 and clear_recall>=0.85) where k=1),
relaxed as (select * from (select *, 'seasonal_relaxed' as origin, {_BEST.format(by="source, season", s="round(target_achievement,12)")} as k from t
  where fog_precision>=0.05 and mist_precision>=0.17 and mist_pod>=0.05 and clear_recall>=0.85 and (source, season) not in (select (source, season) from strict)) where k=1),
fallback as (select * from (select *, 'global_fallback' as origin, {_BEST.format(by="source", s="round(target_achievement,12)")} as k from w
  where fog_precision>=0.05 and mist_precision>=0.15 and clear_recall>=0.85) where k=1),
best as (select source, season, fog_i, mist_i, target_achievement, origin from strict union all select source, season, fog_i, mist_i, target_achievement, origin from relaxed
  union all select ok.source, ok.season, fog_i, mist_i, target_achievement, origin from ok join fallback on ok.source=fallback.source where (ok.source, ok.season) not in (select (source, season) from strict union all select (source, season) from relaxed)),
g as (select [{", ".join(repr(g) for g in V.SEASON_GRID)}] as g)
select source, season, round(g[cast(fog_i+1 as int)],6) as fog_th, round(g[cast(mist_i+1 as int)],6) as mist_th, round(target_achievement,6) as score, origin
from best cross join g where (source, season) in (select (source, season) from ok)""")
def season_search(v):
    found = V.season_threshold_search(v.v_pred.withColumn("season", V.season(F.month("valid_time"))), by=["source"])
    return found.select("source", "season", *[F.round(c, 6).alias(c) for c in ("fog_th", "mist_th", "score")], "origin")


_SCENARIO = f"""(select s.*, tag as scenario from (select *, valid_time + to_hours(8) as lt from {SCORED} p) s,
  unnest(list_filter(['All', case when hour(lt) between 6 and 17 then 'Day' when lt is not null then 'Night' end,
    case when month(lt) in (12,1,2) then 'DJF' when month(lt)<=5 then 'MAM' when month(lt)<=8 then 'JJA' when lt is not null then 'SON' end], lambda x: x is not null)) as t(tag))"""


@query("b16_scenario_tags", f"select source, scenario, count(*) as n from {_SCENARIO} s group by 1,2")
def tags(v):
    tagged = V.scenario_tags(v.v_pred, F.col("valid_time").cast("timestamp_ntz"))
    return tagged.groupBy("source", "scenario").agg(F.count("*").alias("n"))


@query("i12_scenario_metrics", sql_metrics(["n", "accuracy", "fog_csi", "low_vis_csi", "target_achievement"], _SCENARIO, "source, scenario"))
def scenarios(v):
    tagged = V.scenario_tags(scored(v), F.col("valid_time").cast("timestamp_ntz"))
    by = ["source", "scenario"]
    return rounded(V.metrics(V.confusion_matrix(tagged, by), by), ["n", "accuracy", "fog_csi", "low_vis_csi", "target_achievement"], by)


_DELTA = ["accuracy", "fog_csi", "fog_far", "low_vis_csi", "low_vis_fpr"]


@query("i13_metric_delta", f"""
with m as (unpivot ({sql_metrics(_DELTA).replace("round(cast(", "(cast(").replace(" as double),6)", " as double))")}) on {", ".join(_DELTA)} into name metric value value),
d as (select a.metric, a.value as l, b.value as r, a.metric in ('fog_far','low_vis_fpr') as lower_is_better from m a join m b on a.metric=b.metric and a.source='A' and b.source='B')
select metric, round(l,6) as left_value, round(r,6) as right_value, round(l-r,6) as delta, lower_is_better, case when lower_is_better then l<r else l>r end as left_better from d""")
def delta(v):
    out = V.metric_delta(V.metrics(V.confusion_matrix(scored(v))), "A", "B", _DELTA)
    return out.select("metric", F.round("left", 6).alias("left_value"), F.round("right", 6).alias("right_value"), F.round("delta", 6).alias("delta"), "lower_is_better", "left_better")


_PAIR = f"(select a.sample_id, a.y_cls, a.pred as a_pred, b.pred as b_pred from {SCORED} a join {SCORED} b on a.sample_id=b.sample_id and a.source='A' and b.source='B')"


def pairs(v):
    s = scored(v)
    a = s.filter("source = 'A'").select("sample_id", "y_cls", F.col("pred").alias("a_pred"))
    return a.join(s.filter("source = 'B'").select("sample_id", F.col("pred").alias("b_pred")), "sample_id")


@query("i14_win_loss", f"select y_cls, count(*) as n, count(*) filter (where a_pred=y_cls and b_pred<>y_cls) as a_wins, count(*) filter (where b_pred=y_cls and a_pred<>y_cls) as b_wins from {_PAIR} p group by y_cls")
def wins(v):
    flagged = V.win_loss(pairs(v))
    return flagged.groupBy("y_cls").agg(F.count("*").alias("n"), F.count_if("a_wins").alias("a_wins"), F.count_if("b_wins").alias("b_wins"))


@query("i15_class_distribution", """select source, count(*) as n, count(*) filter (where y_cls=0) as n_fog, count(*) filter (where y_cls=1) as n_mist, count(*) filter (where y_cls=2) as n_clear,
  round(avg(case when y_cls=0 then 1.0e0 else 0.0e0 end),6) as rate_fog, round(avg(case when y_cls=1 then 1.0e0 else 0.0e0 end),6) as rate_mist,
  round(avg(case when y_cls=2 then 1.0e0 else 0.0e0 end),6) as rate_clear, round(quantile_cont(vis_m,0.5),6) as vis_p50, round(quantile_cont(vis_m,0.9),6) as vis_p90
  from v_pred group by source""")
def classes(v):
    out = V.class_distribution(v.v_pred, ["source"])
    return out.select(*[F.round(c, 6).alias(c) if c[:3] in ("rat", "vis") else c for c in out.columns])


@query("i16_daily_event_stats", f"""select source, cast(cast(valid_time as date) as varchar) as day, count(*) filter (where y_cls<=1 and pred<=1) as tp, count(*) filter (where y_cls>1 and pred<=1) as fp,
  count(*) filter (where y_cls<=1 and pred>1) as fn, count(*) filter (where y_cls>1 and pred>1) as tn,
  round(sum(pow(p_fog+p_mist-case when y_cls<=1 then 1 else 0 end,2)),6) as sq_error, count(*) as n from {SCORED} s group by 1,2""")
def daily(v):
    return V.daily_event_stats(scored(v), F.col("valid_time").cast("date")).withColumns({"sq_error": F.round("sq_error", 6), "day": F.col("day").cast("string")})


_REF = "(select s.source, month(s.valid_time) as m, s.p_fog as value, r.p_fog as ref from v_pred s join v_pred r on s.sample_id=r.sample_id and r.source='A' and s.source<>'A')"


def referenced(v):
    p = v.v_pred
    ref = p.filter("source = 'A'").select("sample_id", F.col("p_fog").alias("ref"))
    return p.filter("source <> 'A'").select("source", "sample_id", F.month("valid_time").alias("m"), F.col("p_fog").alias("value")).join(ref, "sample_id")


def _extreme(own: bool) -> str:
    return f"""
with p as {_REF}, q as (select source, m, quantile_cont(value,0.9) as o, quantile_cont(ref,0.9) as r from p group by 1,2),
n as (select p.source, 1.0e0*count(*) filter (where ref>r and value>{"o" if own else "r"}) as a, 1.0e0*count(*) filter (where not ref>r and value>{"o" if own else "r"}) as b,
  1.0e0*count(*) filter (where ref>r and not value>{"o" if own else "r"}) as c, 1.0e0*count(*) filter (where not ref>r and not value>{"o" if own else "r"}) as d
  from p join q on p.source=q.source and p.m=q.m group by p.source),
x as (select *, (a+b)*(a+c)/(a+b+c+d) as ch, a/(a+c) as h, b/(b+d) as f from n),
y as (select *, case when h>0 and h<1 and f>0 and f<1 then 1 end as ok from x)
select source, round(h,6) as pod, round(coalesce(b/nullif(a+b,0),0),6) as far, round(a/(a+b+c),6) as csi, round((a-ch)/(a+b+c-ch),6) as ets, round((a+b)/(a+c),6) as bias,
  round(case when ok=1 then (ln(f)-ln(h)-ln(1-f)+ln(1-h))/(ln(f)+ln(h)+ln(1-f)+ln(1-h)) end,6) as sedi from y"""


@query("i17_extreme_contingency", _extreme(False))
def extremes(v):
    out = V.extreme_contingency(referenced(v), "m", "value", "ref", 0.9)
    return out.select("source", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("i17_extreme_contingency_own", _extreme(True))
def extremes_own(v):
    out = V.extreme_contingency(referenced(v), "m", "value", "ref", 0.9, own_quantile=True)
    return out.select("source", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("i18_quantiles", "select source, " + ", ".join(f"round(quantile_cont(p_fog,{q / 100}),6) as p{q}" for q in (50, 90, 95, 99)) + " from v_pred group by source")
def quantiles(v):
    q, _ = V.distribution_table(v.v_pred, F.col("p_fog"), ["source"], 0.0, 1.0, 20)
    return q.select("source", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query("i18_density", "select station_id % 4 as grp, cast(least(floor((t2m_k-270.0e0)/1.5e0),19) as bigint) as bin, count(*) as n from v_field where t2m_k between 270.0e0 and 300.0e0 group by 1,2")
def density(v):
    df = v.v_field.withColumn("grp", F.col("station_id") % 4)
    return V.distribution_table(df, F.col("t2m_k"), ["grp"], 270.0, 300.0, 20)[1].withColumn("bin", F.col("bin").cast("long"))


@query("i19_paired_error_metrics", f"""select source, count(*) as n, round(avg(value-ref),6) as bias, round(avg(abs(value-ref)),6) as mae, round(sqrt(avg(pow(value-ref,2))),6) as rmse,
  round(corr(value,ref),6) as r, round(quantile_cont(value,0.95),6) as p95, round(quantile_cont(ref,0.95),6) as ref_p95, round(quantile_cont(value,0.95)-quantile_cont(ref,0.95),6) as p95_delta
  from {_REF} p group by source""")
def errors(v):
    out = V.paired_error_metrics(referenced(v), ["source"], "value", "ref")
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_BANDED = "(select b.band, g.* from v_grid g, unnest(['all', case when elev_m<100 then '<100' when elev_m<500 then '100-500' else '>=500' end]) as b(band))"


@query("b17_elevation_band", f"select band, count(*) as n from {_BANDED} g group by band")
def bands(v):
    return V.elevation_bands(v.v_grid, F.col("elev_m")).groupBy("band").agg(F.count("*").alias("n"))


@query("i20_banded_quantiles", f"select band, " + ", ".join(f"round(quantile_cont(elev_m,{q / 100}),6) as p{q}" for q in (50, 90, 95, 99)) + f" from {_BANDED} g group by band")
def banded(v):
    out = V.banded_quantiles(V.elevation_bands(v.v_grid, F.col("elev_m")), "elev_m", ["band"])
    return out.select("band", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("j8_mean_ensemble", f"""
with m as (select sample_id, min(y_cls) as y_cls, avg(p_fog) as f, avg(p_mist) as m, avg(p_clear) as c from v_pred where source in ('A','B') group by sample_id having count(distinct source)=2),
e as (select 'ensemble' as source, sample_id, y_cls, round(f/(f+m+c),9) as p_fog, round(m/(f+m+c),9) as p_mist, round(c/(f+m+c),9) as p_clear from m)
{sql_metrics(["n", "accuracy", "fog_csi", "low_vis_csi"], f"(select *, {PRED} as pred from e)")}""")
def ensemble(v):
    members = V.mean_ensemble(v.v_pred, ["A", "B"])
    steady = V.with_pred(members.select(F.lit("ensemble").alias("source"), "y_cls", *[F.round(p, 9).alias(p) for p in V.PROBS]))
    return rounded(V.metrics(V.confusion_matrix(steady)), ["n", "accuracy", "fog_csi", "low_vis_csi"])


@query("j8_ensemble_thresholds", f"""
with r as (select * from ({_RESPONSE}) x where source in ('A','B')), th as (select avg(fog_th) as fog_th, avg(mist_th) as mist_th from r),
m as (select sample_id, min(y_cls) as y_cls, avg(p_fog) as f, avg(p_mist) as m, avg(p_clear) as c from v_pred where source in ('A','B') group by sample_id having count(distinct source)=2),
e as (select 'ensemble' as source, y_cls, fog_th, mist_th, round(f/(f+m+c),9) as p_fog, round(m/(f+m+c),9) as p_mist from m cross join th),
k as (select *, case when p_fog>fog_th and p_fog>p_mist then 0 when p_mist>mist_th and p_mist>p_fog then 1 else 2 end as pred from e)
{sql_metrics(["n", "accuracy", "fog_csi", "low_vis_csi"], "k", "source, fog_th, mist_th")}""".replace("select source, fog_th, mist_th, cast", "select source, round(fog_th,6) as fog_th, round(mist_th,6) as mist_th, cast", 1))
def ensemble_thresholds(v):
    """The mean of the members' thresholds, applied to their ensemble."""
    mean = V.mean_thresholds(response(v), ["A", "B"])
    found = V.mean_ensemble(v.v_pred, ["A", "B"]).select(F.lit("ensemble").alias("source"), "y_cls", *[F.round(p, 9).alias(p) for p in V.PROBS])
    called = found.crossJoin(F.broadcast(mean))  # one row
    called = called.withColumn("pred", V.threshold_class([F.col(p) for p in V.PROBS], F.col("fog_th"), F.col("mist_th")))
    by = ["source", "fog_th", "mist_th"]
    out = rounded(V.metrics(V.confusion_matrix(called, by), by), ["n", "accuracy", "fog_csi", "low_vis_csi"], by)
    return out.withColumns({c: F.round(c, 6) for c in by[1:]})


@query("j8_searched_thresholds", f"""
with m as (select sample_id, min(y_cls) as y_cls, avg(p_fog) as f, avg(p_mist) as m, avg(p_clear) as c from v_pred where source in ('A','B') group by sample_id having count(distinct source)=2),
e as (select 'ensemble' as source, y_cls, round(f/(f+m+c),9) as p_fog, round(m/(f+m+c),9) as p_mist from m), {_RESPONSE.replace("v_pred", "e").removeprefix("with ")}""")
def searched_thresholds(v):
    """Thresholds searched again on the ensemble."""
    found = V.mean_ensemble(v.v_pred, ["A", "B"]).select(F.lit("ensemble").alias("source"), "y_cls", *[F.round(p, 9).alias(p) for p in V.PROBS])
    return V.threshold_search(found, policy="response").select("source", *[F.round(c, 6).alias(c) for c in ("fog_th", "mist_th", "score")], "stage")


def _fit_sql(rounds: int = 3, points: int = 21) -> str:
    """The search on distinct rows: each round a geometric grid between the bounds of the one before."""
    text = "b0 as (select 0.05e0 as lo, 20.0e0 as hi), q as (select y_cls, p_fog, p_mist, p_clear, count(*) as n from v_pred group by all)"
    for i in range(rounds):
        text += f""", g{i} as (select lo*pow(pow(hi/lo,1/{points - 1}.0e0),k) as t, pow(hi/lo,1/{points - 1}.0e0) as step from b{i} cross join (select unnest(range({points})) as k) z),
l{i} as (select t, step, sum(n*(ln(pow(p_fog,1/t)+pow(p_mist,1/t)+pow(p_clear,1/t))-ln(case y_cls when 0 then p_fog when 1 then p_mist else p_clear end)/t))/sum(n) as loss from q cross join g{i} group by 1,2),
m{i} as (select t, step from l{i} order by loss, t limit 1), b{i + 1} as (select greatest(0.05e0, t/step) as lo, least(20.0e0, t*step) as hi from m{i})"""
    return f"with {text} select round(t,6) as t from m{rounds - 1}"


@query("j7_fit_temperature", _fit_sql())
def temperature(v):
    return v.spark.createDataFrame([(V.fit_temperature(v.v_pred),)], "t double").select(F.round("t", 6).alias("t"))


_TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0]


@query("j7_temperature_losses", " union all ".join(f"select {t!r} as t, round(avg(ln(pow(p_fog,1/{t!r})+pow(p_mist,1/{t!r})+pow(p_clear,1/{t!r}))-ln(case y_cls when 0 then p_fog when 1 then p_mist else p_clear end)/{t!r}),6) as loss from v_pred" for t in map(float, _TEMPERATURES)).replace("select ", "select cast(", 0))
def temperatures(v):
    logs = F.array(*[F.log(p) for p in V.PROBS])
    base = v.v_pred.select(logs.alias("z"), F.get(logs, F.col("y_cls")).alias("zy"))
    return V.temperature_losses(base, _TEMPERATURES).select("t", F.round("loss", 6).alias("loss"))
