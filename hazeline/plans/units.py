"""Queries of unit policy and derived fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.functions import physics as P
from hazeline.operators import derive as D
from hazeline.operators import units as U
from hazeline.registry import query

_ROUND = lambda df, names, keep, n=6: df.select(*keep, *[F.round(c, n).alias(c) for c in names])


@query("c1_canonicalize_units", """with m as (select source, variable, quantile_cont(abs(value),0.5) as m from v_units group by 1,2)
select u.source, station_id, h, u.variable, round(case when u.variable='MSLP' and m between 500 and 2000 then value*100 when u.variable='T2M' and m<150 then value+273.15
  when u.variable='RH2M' and m<=1.5 then value*100 when u.variable='Q_1000' and m>0.2 then value/1000 else value end,6) as value
from v_units u join m on m.source=u.source and m.variable=u.variable""")
def units(v):
    return U.canonicalize_units(v.v_units).select("source", "station_id", "h", "variable", F.round("value", 6).alias("value"))


_PM = """p as (select source, station_id, h, declared_units, case when pm10>=0 then pm10 end as x from v_pm),
m as (select source, quantile_cont(case when x>0 then x end,0.5) as m from p group by 1),
c as (select p.source, station_id, h, x*case when declared_units='legacy_kgm3_times_1e12' then 1e-3 when m is null then 1 when m<1e-3 then 1e9 when m>1e4 then 1e-3 else 1 end as x from p join m on m.source=p.source)"""


@query("c2_canonicalize_pm", f"with {_PM} select source, station_id, h, round(x,6) as pm10 from c")
def pm(v):
    return U.canonicalize_pm(v.v_pm, "pm10", "declared_units", ["source"]).select("source", "station_id", "h", F.round("pm10", 6).alias("pm10"))


@query("c3_sanitize_pm", f"with {_PM}, k as (select source, station_id, h, case when x between 0 and 10000 then x end as x from c), f as (select source, quantile_cont(x,0.5) as f from k group by 1) select k.source, station_id, h, round(coalesce(x,f,0),6) as pm10 from k join f on f.source=k.source")
def pm_clean(v):
    return U.sanitize_pm(v.v_pm, "pm10", "declared_units", ["source"]).select("source", "station_id", "h", F.round("pm10", 6).alias("pm10"))


@query("c4_normalize_rh", """with r as (select source, station_id, h, value from v_units where variable='RH2M'), p as (select source, quantile_cont(value,0.99) as p from r group by 1)
select r.source, station_id, h, round(case when value is null then null else least(greatest(case when p<=2 then value*100 else value end,0),100) end,6) as rh from r join p on p.source=r.source""")
def rh(v):
    df = U.normalize_rh(v.v_units.filter("variable = 'RH2M'"), "value", ["source"])
    return df.select("source", "station_id", "h", F.round("value", 6).alias("rh"))


_Q = "select source, station_id, h, value, case when source='A' then 'g kg-1' end as declared from v_units where variable='Q_1000'"


@query("c5_q_to_gkg", f"with q as ({_Q}), p as (select source, quantile_cont(abs(value),0.99) as p from q group by 1) select q.source, station_id, h, case when declared is not null then 'declared g/kg' when p<0.2 then 'inferred kg/kg' else 'inferred g/kg' end as provenance, round(case when declared is null and p<0.2 then value*1000 else value end,6) as q from q join p on p.source=q.source")
def q_gkg(v):
    return U.q_to_gkg(v.sql(_Q), "value", "declared", ["source"]).select("source", "station_id", "h", "provenance", F.round("value", 6).alias("q"))


_SPLIT = "select station_id, h, case when h<500 then 'train' else 'test' end as split, pm10 from v_pm where source='micro'"


@query("c6_train_only_fill", f"""with t as (select * from ({_SPLIT}) s where split='train'), k as (select *, row_number() over (order by b) as r, count(*) over () as n from (select least(floor(pm10),9999) as b from t where pm10 between 0 and 10000) x)
select (select b+0.5 from k where r=(n-1)//2+1) as fill, (select count(*) from t) as n_total, (select count(*) from t where not coalesce(pm10 between 0 and 10000, false)) as n_invalid""")
def fill(v):
    return U.train_only_fill(v.sql(_SPLIT), "pm10")


@query("c7_physical_range_summary", "select station_id%3 as g, count(q_gkg) as n, min(q_gkg) as min, " + ", ".join(f"round(quantile_cont(q_gkg,{p}),6) as {n}" for p, n in ((0.001, "p0_1"), (0.01, "p1"), (0.99, "p99"), (0.999, "p99_9"))) + ", max(q_gkg) as max, count(*) filter (where q_gkg<0) as n_negative, count(*) filter (where q_gkg<-0.01) as n_under, count(*) filter (where q_gkg>40) as n_over_40, count(*) filter (where q_gkg>80) as n_over_80, 1.0e0*count(*) filter (where q_gkg<-0.01 or q_gkg>40)/count(q_gkg) as outside_fraction from v_field group by 1")
def ranges(v):
    out = U.physical_range_summary(v.v_field.withColumn("g", F.col("station_id") % 3), "q_gkg", ["g"])
    return out.select(*[F.round(c, 6).alias(c) if c[0] == "p" else F.col(c) for c in out.columns])


@query("c8_encoding_stats", "select source, count(*) as n, round(1.0e0*count(pm10)/count(*),6) as finite_fraction, " + ", ".join(f"round(quantile_cont(pm10,{p}),9) as q{i}" for i, p in enumerate((0.0, 0.001, 0.01, 0.5, 0.99, 0.999, 1.0))) + ", round(1.0e0*count(*) filter (where pm10<0)/count(*),6) as negative_fraction, round(1.0e0*count(*) filter (where pm10<0 or pm10>10000)/count(*),6) as outside_fraction, min(h) as time_min, max(h) as time_max from v_pm group by 1")
def encoding(v):
    out = U.encoding_stats(v.v_pm, "pm10", 1.0, ["source"], "h")
    return out.select("source", "n", "time_min", "time_max", *[F.round(c, 9 if c[0] == "q" else 6).alias(c) for c in out.columns if c[0] == "q" or c.endswith("fraction")])


_ES = lambda t: f"(6.112*exp(17.67*({t}-273.15)/({t}-273.15+243.5)))"
_TD = lambda r: f"(243.5*({r})/greatest(17.67-({r}),1e-6)+273.15)"
_DQ = lambda q, p: _TD(f"ln(greatest(least(greatest({q},1e-8),0.08)*{p}/(0.622+0.378*least(greatest({q},1e-8),0.08)),1e-6)/6.112)")


@query("d1_rh_from_dewpoint", f"select station_id, h, round(least(greatest(100*{_ES('dp_1000')}/{_ES('t2m')},0),100),6) as rh from v_met")
def d1(v):
    return v.v_met.select("station_id", "h", F.round(P.rh_from_dewpoint(F.col("t2m"), F.col("dp_1000")), 6).alias("rh"))


_DRH = _TD("ln(least(greatest(rh2m/100,1e-4),1))+17.67*(t2m-273.15)/(243.5+t2m-273.15)")


@query("d2_dewpoint_from_rh", f"select station_id, h, round({_DRH},6) as td from v_met")
def d2(v):
    return v.v_met.select("station_id", "h", F.round(P.dewpoint_from_rh(F.col("t2m"), F.col("rh2m")), 6).alias("td"))


@query("d3_dewpoint_from_q", f"select station_id, h, round({_DQ('q_1000', 1000)},6) as td from v_met")
def d3(v):
    return v.v_met.select("station_id", "h", F.round(P.dewpoint_from_q(F.col("q_1000"), 1000.0), 6).alias("td"))


_QRH = lambda t, rh, p: f"(with_r/(1+with_r))".replace("with_r", f"(0.622*least(greatest({rh}/100,0),1)*{_ES(t)}/({p}-least(greatest({rh}/100,0),1)*{_ES(t)}))")


@query("d4_q_from_t_rh", f"select station_id, h, round(least(greatest({_QRH('t_925', 'rh_925', 925)},0),0.08),9) as q from v_met")
def d4(v):
    return v.v_met.select("station_id", "h", F.round(P.q_from_t_rh(F.col("t_925"), F.col("rh_925"), 925.0), 9).alias("q"))


_DIR = lambda u, w: f"round(case when 270-degrees(atan2({w},{u}))>=360 then 270-degrees(atan2({w},{u}))-360 else 270-degrees(atan2({w},{u})) end,6)"


@query("d5_wind_speed_dir", f"select station_id, h, round(sqrt(u10*u10+v10*v10),6) as speed, {_DIR('u10', 'v10')} as direction from v_met")
def d5(v):
    u, w = F.col("u10"), F.col("v10")
    return v.v_met.select("station_id", "h", F.round(P.wind_speed(u, w), 6).alias("speed"), F.round(P.wind_direction(u, w), 6).alias("direction"))


@query("d6_precip_increment", "with d as (select station_id, h, precip_acc as x, precip_acc-lag(precip_acc) over (partition by station_id order by h) as d from v_field) select station_id, h, greatest(case when d is null then 0 when d<0 then x else d end,0) as precip from d")
def d6(v):
    return D.precip_increment(v.v_field, "precip_acc").select("station_id", "h", F.col("precip_acc").alias("precip"))


_G = "((1+floor(h/24)-1+((h%24)-12)/24.0)*(2*pi()/365.0))"


@query("d7_solar_zenith", f"""with s as (select f.station_id, f.h, lat, lon, {_G} as g, (f.h%24)*1.0e0 as hr from v_field f join v_station s on s.station_id=f.station_id),
d as (select *, 0.006918-0.399912*cos(g)+0.070257*sin(g)-0.006758*cos(g*2)+0.000907*sin(g*2)-0.002697*cos(g*3)+0.00148*sin(g*3) as dec,
  (0.000075+0.001868*cos(g)-0.032077*sin(g)-0.014615*cos(g*2)-0.040849*sin(g*2))*229.18 as eqt from s)
select station_id, h, round(degrees(acos(least(greatest(sin(radians(lat))*sin(dec)+cos(radians(lat))*cos(dec)*cos(radians((hr*60+eqt+lon*4)/4-180)),-1),1))),5) as zenith from d""")
def d7(v):
    df = v.v_field.select("station_id", "h").join(v.v_station, "station_id")
    out = D.solar_zenith(df, "station_id", "h", F.floor(F.col("h") / 24) + 1, F.col("h") % 24)
    return out.select("station_id", "h", F.round("ZENITH", 5).alias("zenith"))


@query("d8_contrasts", "select station_id, h, round(t2m-dp_1000,6) as dpd, round(t_925-t2m,6) as inversion, round(q_1000-q_925,9) as q_diff from v_met")
def d8(v):
    df = D.contrasts(v.v_met.select("station_id", "h", F.col("t2m").alias("T2M"), F.col("dp_1000").alias("D2M"), F.col("t_925").alias("T_925"), F.col("q_1000").alias("Q_1000"), F.col("q_925").alias("Q_925")))
    return df.select("station_id", "h", F.round("DPD", 6).alias("dpd"), F.round("INVERSION", 6).alias("inversion"), F.round("Q1000_MINUS_Q925", 9).alias("q_diff"))


@query("d9_derive_fields", f"""with q as (select *, least(greatest({_QRH('t_925', 'rh_925', 925)},0),0.08) as q9 from v_met)
select station_id, h, round(sqrt(u10*u10+v10*v10),6) as wspd10, {_DIR('u10', 'v10')} as wdir10, round(q9,9) as q_925, round({_DQ('q9', 925)},5) as dp_925, round(dp_1000,6) as dp_1000,
  round(t2m-{_DRH},5) as dpd, round(t_925-t2m,6) as inversion from q""")
def d9(v):
    given = ["t2m", "rh2m", "u10", "v10", "t_925", "rh_925", "q_1000", "dp_1000"]
    out = D.derive_fields(v.v_met.select("station_id", "h", *[F.col(n).alias(n.upper()) for n in given]))
    places = {"WSPD10": 6, "WDIR10": 6, "Q_925": 9, "DP_925": 5, "DP_1000": 6, "DPD": 5, "INVERSION": 6}
    return out.select("station_id", "h", *[F.round(c, n).alias(c.lower()) for c, n in places.items()])


@query("k13_dewpoint_consistency", f"select station_id%4 as g, round(avg(abs(dp_1000-{_DQ('q_1000', 1000)})),6) as mae from v_met group by 1")
def k13(v):
    out = U.dewpoint_consistency(v.v_met.withColumn("g", F.col("station_id") % 4), "dp_1000", "q_1000", 1000.0, ["g"])
    return out.select("g", F.round("mae", 6).alias("mae"))
