"""Queries of keys, names, layouts, labels and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.functions import layouts
from hazeline.functions import physics as P
from hazeline.operators import normalise as N
from hazeline.registry import query

_RAW = """select n, count(*) as k from (select case user_id % 6 when 0 then ' rh925' when 1 then 'Dew-Point 2M' when 2 then 'pm2.5' when 3 then 'T 1000' when 4 then 'pm10_ugm3' else 't2m' end as n from events) x group by n"""
_ALIAS_ROWS = ", ".join(f"('{alias}','{name}')" for alias, name in layouts.NAMES.items())


@query("b1_canonical_name", f"""
with r as ({_RAW}), a(alias, name) as (values {_ALIAS_ROWS}), u as (select n, k, regexp_replace(upper(trim(n)),'[- ]','_','g') as u from r)
select u.n, coalesce(a.name, b.name, trim(u.n)) as canonical, k from u left join a on a.alias=u.u left join a b on b.alias=replace(u.u,'_','')""")
def names(v):
    return v.sql(_RAW).select("n", N.canonical_name(F.col("n")).alias("canonical"), "k")


_STATIONS = "select ' s' || cast(station_id as varchar(20)) || '.0 ' as a, cast(station_id*1.0e0 as varchar(30)) as b from v_station"


@query("b2_station_key", f"select a, upper(regexp_replace(trim(a),'\\.0$','')) as k, coalesce(cast(cast(try_cast(b as double) as bigint) as varchar), trim(b)) as n from ({_STATIONS}) s")
def keys(v):
    return v.sql(_STATIONS).select("a", N.station_key(F.col("a")).alias("k"), N.numeric_station_key(F.col("b")).alias("n"))


@query("b3_time_key", "select event_id, strftime(date_trunc('second', ts) - interval 8 hour, '%Y-%m-%d %H:%M:%S') as k from events")
def times(v):
    return v.table("events").select("event_id", N.time_key(F.col("ts"), -8).alias("k"))


_SETS = ("common_core", "compact_common_core", "q_core_no_rh2m", "overlap_full", "source_full")
_FIELDS = "select source, replace(variable,'_','') as variable from v_units union all select 'C', case when h%5=0 then 'u10' when h%5=1 then 'v10' when h%5=2 then 't925' when h%5=3 then 'rh925' else 't2m' end from v_field"


def _listed(*values) -> str:
    return "(" + ",".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + ")"


def _available() -> str:
    upper = "replace(replace(upper(trim(variable)),'-','_'),' ','_')"
    given = [f"select source, '{slot}' as name from c where name in {_listed(*needs)} group by source having count(*)={len(needs)}" for slot, needs in layouts.DERIVED]
    return f"""n(alias, name) as (values {",".join(_listed(*x) for x in layouts.NAMES.items())}),
o(pos, name) as (values {",".join(_listed(i, x) for i, x in enumerate(layouts.ORDER))}),
c as (select distinct source, coalesce(a.name, b.name, trim(variable)) as name from ({_FIELDS}) f left join n a on a.alias={upper} left join n b on b.alias=replace({upper},'_','')),
d as (select source, name from c union {" union ".join(given)}), av as (select source, o.pos, name from d join o using (name))"""


@query("b4_feature_sets", f"""with {_available()},
s(feature_set, pos, name) as (values {",".join(_listed(k, i, x) for k, xs in layouts.SETS.items() for i, x in enumerate(xs))})
select g.source, feature_set, cast(s.pos as int) as pos, s.name, av.name is not null as held from (select distinct source from av) g cross join s left join av on av.source=g.source and av.name=s.name
union all select source, 'source_full', cast(row_number() over (partition by source order by pos)-1 as int), name, true from av""")
def sets(v):
    return N.resolved_layouts(v.sql(_FIELDS), _SETS)


@query("b5_available_features", f"with {_available()} select source, string_agg(name, ',' order by pos) as features from av group by source")
def available(v):
    out = N.available_features(v.sql(_FIELDS))
    return out.select("source", F.array_join("features", ",").alias("features"))


@query("b6_scatter_fields", """select source, station_id, h, coalesce(max(case when variable='T2M' then value end),0) as T2M, coalesce(max(case when variable='RH2M' then value end),0) as RH2M,
  coalesce(max(case when variable='CAPE' then value end),0) as CAPE from v_units group by 1,2,3""")
def scatter(v):
    return N.scatter_fields(v.v_units, ["source", "station_id", "h"], ["T2M", "RH2M", "CAPE"])


@query("b7_select_layout", "select station_id, h, 'U10' as variable, u10 as value from v_met union all select station_id, h, 'T2M', t2m from v_met")
def layout_long(v):
    named = v.v_met.select("station_id", "h", F.col("u10").alias("U10"), F.col("t2m").alias("T2M"), "cape")
    return N.to_long(N.select_layout(named, ["station_id", "h"], ["U10", "T2M"]), ["station_id", "h"], ["U10", "T2M"])


_KM = "select station_id, h, vis_m/1000.0e0 as vis from v_obs"


@query("b8_visibility_class", """with k as (select station_id, h, vis_m/1000.0e0 as vis from v_obs), t as (select max(vis) as top from k), m as (select station_id, h, case when top<100 then vis*1000 else vis end as vis from k, t)
select station_id, h, round(vis,6) as vis, case when vis<500 then 0 when vis<1000 then 1 else 2 end as y_cls from m""")
def vis_class(v):
    m = N.in_metres(v.sql(_KM), "vis")
    return m.select("station_id", "h", F.round("vis", 6).alias("vis"), P.visibility_class(F.col("vis")).alias("y_cls"))


@query("b9_label_qc", "select station_id, h, vis_m from v_obs where vis_m between 0 and 15000")
def qc(v):
    return N.label_qc(v.v_obs, "vis_m", 15_000.0)


@query("b9_label_violations", "select count(*) as n, cast(0 as bigint) as n_missing, count(*) filter (where vis_m<0) as n_negative, count(*) filter (where vis_m>15000) as n_over from v_obs")
def violations(v):
    return N.label_violations(v.v_obs, "vis_m", 15_000.0)


@query("b10_soft_label", """select sample_id, source, vis_m,
 round(case when vis_m<400 then 1 when vis_m<600 then 1-(vis_m-400)/200 else 0 end,6) as s0,
 round(case when vis_m<400 then 0 when vis_m<600 then (vis_m-400)/200 when vis_m<800 then 1 when vis_m<1200 then 1-(vis_m-800)/400 else 0 end,6) as s1,
 round(case when vis_m<800 then 0 when vis_m<1200 then (vis_m-800)/400 else 1 end,6) as s2 from v_pred""")
def soft(v):
    s = P.soft_label(F.col("vis_m"))
    return v.v_pred.select("sample_id", "source", "vis_m", *[F.round(s[i], 6).alias(f"s{i}") for i in range(3)])


_INPUT = ["PRECIP", "CAPE", "T2M"]


def _inputs(v):
    df = v.v_met.select("station_id", "h", *[F.col(n.lower()).alias(n) for n in _INPUT])
    return N.logged(df, ["PRECIP", "CAPE"])


_LONG = "(select station_id, h, 'PRECIP' as name, ln(1+precip) as value from v_met union all select station_id, h, 'CAPE', ln(1+cape) from v_met union all select station_id, h, 'T2M', t2m from v_met)"


@query("j9_fit_robust_scaler", f"select name, round(quantile_cont(value,0.5),6) as center, round(quantile_cont(value,0.95)-quantile_cont(value,0.05),6) as scale from {_LONG} l group by name")
def scaler(v):
    return N.fit_robust_scaler(_inputs(v), _INPUT).select("name", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query("b11_model_input", f"""with s as (select name, quantile_cont(value,0.5) as c, quantile_cont(value,0.95)-quantile_cont(value,0.05) as w from {_LONG} l group by name)
select station_id, h, l.name, round(least(greatest((value-c)/(w+1e-6),-10),10),5) as scaled from {_LONG} l join s on l.name=s.name""")
def scaled(v):
    df = _inputs(v)
    out = N.model_input(df.unpivot(["station_id", "h"], _INPUT, "name", "value"), N.fit_robust_scaler(df, _INPUT))
    return out.select("station_id", "h", "name", F.round("scaled", 5).alias("scaled"))


@query("b13_cyclical_time", """select source, sample_id, round(sin(2*pi()*month(valid_time)/12),6)+0.0e0 as month_sin, round(cos(2*pi()*month(valid_time)/12),6)+0.0e0 as month_cos,
  round(sin(2*pi()*(station_id%24)/24),6)+0.0e0 as hour_sin, round(cos(2*pi()*(station_id%24)/24),6)+0.0e0 as hour_cos, cast(month(valid_time) as int) as month from v_pred""")
def cyclical(v):
    c = P.cyclical(F.month("valid_time"), F.col("station_id") % 24)
    back = P.month_of(c["month_sin"], c["month_cos"]).alias("month")
    return v.v_pred.select("source", "sample_id", *[(F.round(x, 6) + 0.0).alias(k) for k, x in c.items()], back)


@query("b14_station_filter", "select station_id, lat, lon from v_station where lat between 10 and 60 and lon between 65 and 145")
def stations(v):
    return N.station_filter(v.v_station)


@query("b15_lon_wrap", "select station_id, round(case when lon*3>=360 then lon*3-360 else lon*3 end,6) as around, round(case when lon*3>=360 then lon*3-360 when lon*3>180 then lon*3-360 else lon*3 end,6) as signed_lon from v_station")
def wrap(v):
    lon = F.col("lon") * 3
    return v.v_station.select("station_id", F.round(P.wrap_longitude(lon), 6).alias("around"), F.round(P.wrap_longitude(lon, True), 6).alias("signed_lon"))
