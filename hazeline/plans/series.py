"""Queries of series, leads and fog features."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.operators import series as S
from hazeline.registry import query

_W = "window w as (partition by station_id order by h), l as (partition by station_id order by h rows between 11 preceding and current row)"


@query("f1_sliding_window", f"""with a as (select station_id, h, list(t2m) over l as xs, h-lag(h,11) over w as span, row_number() over w as r from v_met {_W})
select station_id, h, list_sum(xs) as total, xs[1] as oldest, xs[12] as latest from a where len(xs)=12 and span=11""")
def sliding(v):
    out = S.sliding_window(v.v_met.select("station_id", "h", "t2m"), ["t2m"])
    total = F.aggregate("win", F.lit(0.0), lambda a, x: a + x["t2m"])
    return out.select("station_id", "h", total.alias("total"), F.col("win")[0]["t2m"].alias("oldest"), F.col("win")[11]["t2m"].alias("latest"))


def sql_stats(c: str) -> str:
    return f"{c}-lag({c},3) over w as {c}_d3, {c}-lag({c},6) over w as {c}_d6, round(stddev_pop({c}) over l,6) as {c}_std, max({c}) over l-min({c}) over l as {c}_range"


@query("f2_window_stats", f"select station_id, h, {sql_stats('t2m')} from v_met {_W}")
def stats(v):
    cols = S.window_stats("t2m")
    return S.with_last(v.v_met.select("station_id", "h", "t2m"), ["t2m"]).select("station_id", "h", *[(F.round(x, 6) if k.endswith("std") else x).alias(k) for k, x in cols.items()])


@query("f3_acceleration", f"select station_id, h, (rh2m-lag(rh2m,3) over w)-(lag(rh2m,3) over w-lag(rh2m,6) over w) as accel from v_met {_W}")
def accel(v):
    return S.with_last(v.v_met.select("station_id", "h", "rh2m"), ["rh2m"]).select("station_id", "h", S.acceleration("rh2m").alias("accel"))


_OBS_AXIS = """with x as (select station_id, h, h-lag(h) over (partition by station_id order by h) as d from (select distinct station_id, h from v_obs) a)"""


@query("f4_time_axis_summary", f"""{_OBS_AXIS}, g as (select station_id, d, count(*) as c from x where d is not null group by 1,2)
select x.station_id, count(*) as n, min(h) as start, max(h) as "end", min(d) as min_delta, max(d) as max_delta, count(*) filter (where d<>1) as n_irregular,
  (select string_agg(cast(d as varchar)||':'||cast(c as varchar), ',' order by d) from g where g.station_id=x.station_id) as deltas from x group by 1""")
def axis(v):
    out = S.time_axis_summary(v.v_obs, by=["station_id"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("deltas")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.withColumn("deltas", F.when(F.size("deltas") > 0, text))


_SEG = "select station_id%5 as g, floor(h/168) as wk, h*60+case when h%50=0 then 20 else 0 end as minute from v_obs"


@query("f5_segment_cadence", f"""with x as (select g, wk, minute, minute-lag(minute) over (partition by g, wk order by minute) as d from (select distinct * from ({_SEG}) s) a)
select g, wk, count(*) as n, count(*) filter (where minute%60<>0) as n_off, count(*) filter (where d=60) as n_unit, count(*) filter (where d%60<>0) as n_broken from x group by 1,2""")
def cadence(v):
    return S.segment_cadence(v.sql(_SEG), ["g", "wk"])


_LEAD = "select station_id, h, case when h%3=0 then null else h-h%24 end as init, case when h%4=0 then null when h%21=1 then h%24+1.0e0 else (h%24)*1.0e0 end as said from v_field"


@query("f6_lead_evidence", f"""with x as (select *, h-init as made, (case when h%24<12 then h%24+12 else h%24 end)*1.0e0 as guess from ({_LEAD}) l)
select station_id, h, cast(coalesce(made, said, guess) as double) as lead, case when made is not null then 'valid minus init' when said is not null then 'declared' else 'stitched runs' end as provenance,
  coalesce(abs(made-said)>1e-6,false) as disagrees from x""")
def leads(v):
    return S.lead_evidence(v.sql(_LEAD), "h", "init", "said", stitched=True).select("station_id", "h", "lead", "provenance", "disagrees")


@query("f6_lead_summary", f"""with x as (select *, h-init as made, (case when h%24<12 then h%24+12 else h%24 end)*1.0e0 as guess from ({_LEAD}) l),
e as (select station_id%3 as grp, cast(coalesce(made, said, guess) as double) as lead, case when made is not null then 'valid minus init' when said is not null then 'declared' else 'stitched runs' end as provenance,
  coalesce(abs(made-said)>1e-6,false) as bad from x), p as (select grp, provenance, lead, count(*) as n, count(*) filter (where bad) as d from e group by 1,2,3)
select grp, provenance, cast(sum(n) as bigint) as n, min(lead) as lead_min, max(lead) as lead_max, cast(sum(d) as bigint) as n_disagree, string_agg(cast(cast(lead as bigint) as varchar)||':'||cast(n as varchar), ',' order by lead) as leads from p group by 1,2""")
def lead_ranges(v):
    leads = S.lead_evidence(v.sql(_LEAD), "h", "init", "said", stitched=True).withColumn("grp", F.col("station_id") % 3)
    text = F.transform(F.array_sort(F.map_entries("leads")), lambda e: F.concat_ws(":", e["key"].cast("long").cast("string"), e["value"].cast("string")))
    return S.lead_summary(leads, ["grp"]).withColumn("leads", F.array_join(text, ","))


_CANON = {"rh2m": "RH2M", "t2m": "T2M", "precip": "PRECIP", "mslp": "MSLP", "sw_rad": "SW_RAD", "u10": "U10", "v10": "V10", "wspd10": "WSPD10", "wdir10": "WDIR10",
          "cape": "CAPE", "lcc": "LCC", "t_925": "T_925", "rh_925": "RH_925", "u_925": "U_925", "v_925": "V_925", "wspd925": "WSPD925", "dp_1000": "DP_1000",
          "dp_925": "DP_925", "q_1000": "Q_1000", "q_925": "Q_925", "w_925": "W_925", "w_1000": "W_1000", "dpd": "DPD", "inversion": "INVERSION", "zenith": "ZENITH"}


def met(v, *absent):
    return v.v_met.select("station_id", "h", *[F.col(k).alias(c) for k, c in _CANON.items() if c not in absent])


def _sig(x: str) -> str:
    return f"(1/(1+exp(-({x}))))"


_T = {
    "rh": "least(greatest(rh2m/100,0),1)", "rh925": "least(greatest(rh_925/100,0),1)", "dpd": "(1/(1+exp(dpd/2)))", "wind": "exp(-0.5*pow((wspd10-3.5)/2.5,2))",
    "stab": "tanh(inversion/(wspd10*wspd10+0.1)/2)", "night": "(case when zenith>90 then 1.0e0 else 0.0e0 end)",
    "nrad": "(case when zenith>90 then 1.0e0 else 0.0e0 end)*least(greatest(1-lcc/0.3,0),1)*(1-least(greatest(greatest(sw_rad,0)/800,0),1))",
    "shear": "sqrt(pow(u_925-u10,2)+pow(v_925-v10,2))", "turn": "0.5*(1-cos(atan2(v_925,u_925)-atan2(v10,u10)))",
}
_T["vent"] = f"tanh(wspd10*(1+{_T['shear']})/12)"
_T["conv"] = _sig("(ln(1+greatest(cape,0))-ln(200))*1.6") + "*" + _sig("(ln(1+greatest(precip,0))-ln(0.1))*2.5")
_T["mix"] = _sig("(greatest(sw_rad,0)-150)/75") + "*" + _sig("(wspd10-4)/1.5") + "*" + _sig("(0.5-inversion)/1.2")
_T["strat"], _T["omega"] = "tanh((q_1000-q_925)*1500)", "tanh((w_925-w_1000)/0.25)"
_T["warm"] = "tanh((-inversion+greatest(t2m-273.15-18,0)*0.25)/3)"
_T["heat"] = "rh2m*exp(-(t2m-273.15)/10)"


def _stat4(c: str) -> dict[str, str]:
    return {f"{c}_d3": f"coalesce({c}-lag({c},3) over w,0)", f"{c}_d6": f"coalesce({c}-lag({c},6) over w,0)", f"{c}_std": f"stddev_pop({c}) over l", f"{c}_range": f"max({c}) over l-min({c}) over l"}


def _accel(c: str) -> str:
    return f"coalesce(({c}-lag({c},3) over w)-(lag({c},3) over w-lag({c},6) over w),0)"


def _features(cols: dict[str, str], frm: str = "v_met") -> str:
    return f"select station_id, h, {', '.join(f'round({x},5)+0.0e0 as {k}' for k, x in cols.items())} from {frm} {_W}"


def _rounded(df):
    """Five digits; scaled first, as rounding to digits takes ties (products of short decimals) by their decimal text."""
    return df.select("station_id", "h", *[(F.round(F.col(c) * 1e5) / 1e5 + 0.0).alias(c) for c in df.columns[2:]])


_NATIVE = {
    "moist": f"{_T['rh']}*{_T['dpd']}", "wind": _T["wind"], "stability": _T["stab"], "night_rad": _T["nrad"], "rh_contrast": "tanh((rh2m-rh_925)/50)",
    "fog_potential": f"(0.4*{_T['rh']}+0.25*{_T['dpd']}+0.2*{_T['wind']}+0.15*least(greatest({_T['stab']},0),1)+0.15*{_T['nrad']})/1.15",
    **{k: x for c in ("rh2m", "t2m", "wspd10", "dpd", "rh_925", "q_1000", "q_925") for k, x in _stat4(c).items()},
    "shear": f"tanh({_T['shear']}/8)", "turn": _T["turn"], "vent": _T["vent"], "convective": _T["conv"], "mixing": _T["mix"], "strat": _T["strat"], "omega": _T["omega"],
    "warm": _T["warm"], "moist_heat": _T["heat"], "rh_cloud": "rh2m/(lcc*100+1)",
}
query("g1_fog_features_native", _features(_NATIVE))(lambda v: _rounded(S.fog_features_native(met(v))))
_QCORE = {k: x for k, x in _NATIVE.items() if k in ("wind", "shear", "turn", "vent", "strat") or k[:-3].rstrip("_") in ("t2m", "wspd10", "rh_925", "q_1000", "q_925") or k.split("_d")[0].split("_s")[0].split("_r")[0] in ("t2m", "wspd10") or k[:6] in ("rh_925", "q_1000") or k[:5] == "q_925"}
_QCORE |= {"night_rad": _T["night"], "fog_potential": f"(0.2*{_T['wind']}+0.15*{_T['night']})/0.35"}
_ABSENT = ("RH2M", "PRECIP", "SW_RAD", "CAPE", "LCC", "T_925", "W_925", "W_1000", "DPD", "INVERSION")
query("g1_fog_features_native_q_core", _features(_QCORE))(lambda v: _rounded(S.fog_features_native(met(v, *_ABSENT))))
_FULL = {
    "moist": _NATIVE["moist"], "wind": _T["wind"], "stability": _T["stab"], "night_rad": _T["nrad"], "rh_contrast": _NATIVE["rh_contrast"],
    "fog_potential": f"0.4*{_T['rh']}+0.25*{_T['wind']}+0.2*least(greatest({_T['stab']},0),1)+0.15*{_T['nrad']}",
    **{k: x for c in ("rh2m", "t2m", "wspd10") for k, x in _stat4(c).items()}, "rh_accel": _accel("rh2m"), "moist_heat": _T["heat"],
    "night_clear": f"{_T['night']}*(1-lcc)", "fog_rule": "case when rh2m>90 and t2m-273.15<10 and wspd10<4 then 1 else 0 end", "rh_cloud": _NATIVE["rh_cloud"],
    "rh_squared": "pow(rh2m/100,2)", "shear": _NATIVE["shear"], "turn": _T["turn"], "convective": _T["conv"], "mixing": _T["mix"], "vent": _T["vent"], "strat": _T["strat"],
    "omega": _T["omega"], "warm": _T["warm"],
}
query("g2_fog_features_full", _features(_FULL))(lambda v: _rounded(S.fog_features_full(met(v))))
_COMPACT = {
    "dpd_weight": _T["dpd"], "wind": _T["wind"], "rh925": _T["rh925"], "fog_potential": f"0.45*{_T['dpd']}+0.25*{_T['rh925']}+0.15*{_T['wind']}+0.15*{_T['night']}",
    **{k: x for c in ("t2m", "wspd10", "dpd") for k, x in _stat4(c).items()}, "dpd_accel": _accel("dpd"), "dpd_heat": f"{_T['dpd']}*exp(-(t2m-273.15)/10)",
    "night_moist": "case when zenith>90 and dpd<2 then 1 else 0 end", "fog_rule": "case when dpd<2 and t2m-273.15<10 and wspd10<4 then 1 else 0 end", "dpd_squared": f"pow({_T['dpd']},2)",
    "shear": _NATIVE["shear"], "turn": _T["turn"], "vent": _T["vent"], "strat": _T["strat"], "dp_contrast": "tanh((dp_1000-dp_925)/8)", "pressure_anomaly": "tanh((mslp-med)/2000)",
}
query("g3_fog_features_compact", _features(_COMPACT, "(select *, (select quantile_cont(mslp,0.5) from v_met) as med from v_met) m"))(lambda v: _rounded(S.fog_features_compact(met(v))))
