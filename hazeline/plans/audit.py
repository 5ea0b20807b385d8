"""Queries of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.operators import audit as A
from hazeline.operators.normalise import robust_scaler
from hazeline.registry import query

_LONG = "select source, case when h<400 then 'train' else 'test' end as split, variable as feature, case when variable='T2M' and source='B' then 0.0e0 else value end as value from v_units"
_BOUNDS = "(values ('T2M',200.0e0,330.0e0),('MSLP',80000.0e0,110000.0e0),('RH2M',0.0e0,100.0e0)) as b(feature, low, high)"
_SCAN = f"""select source, split, feature, count(*) as n, 1.0e0*count(value)/count(*) as finite_fraction, 1.0e0*count(*) filter (where abs(value)>1e-12)/count(*) as nonzero_fraction,
  1.0e0*count(*) filter (where value<low or value>high)/count(*) as outside_fraction, avg(value) as mean, min(value) as min, max(value) as max from ({_LONG}) l left join (select * from {_BOUNDS}) b using (feature) group by 1,2,3"""


def scan(v):
    return A.feature_quality_scan(v.sql(_LONG), v.spark.sql(f"select * from {_BOUNDS}"))


@query("k1_feature_quality_scan", f"select source, split, feature, n, round(finite_fraction,6) as finite_fraction, round(nonzero_fraction,6) as nonzero_fraction, round(outside_fraction,6) as outside_fraction, round(mean,6) as mean, round(min,6) as min, round(max,6) as max from ({_SCAN}) s")
def quality(v):
    return scan(v).select("source", "split", "feature", "n", *[F.round(c, 6).alias(c) for c in ("finite_fraction", "nonzero_fraction", "outside_fraction", "mean", "min", "max")])


@query("k2_quality_issues", f"with s as ({_SCAN}) select source, split, feature, 'not finite' as issue from s where finite_fraction<0.99 union all select source, split, feature, 'all zero' from s where nonzero_fraction<=1e-6 union all select source, split, feature, 'outside bounds' from s where outside_fraction>0.01")
def issues(v):
    return A.quality_issues(scan(v))


@query("k3_valid_time_scope", "select source, count(*) filter (where year(valid_time)=1997) as n_year, count(*) filter (where valid_time>=date '1998-01-01' and valid_time<date '1998-01-06') as n_spill, count(*) filter (where not year(valid_time)=1997 and not (valid_time>=date '1998-01-01' and valid_time<date '1998-01-06')) as n_outside from v_pred group by 1")
def scope(v):
    return A.valid_time_scope(v.v_pred, F.col("valid_time"), 1997, 5, ["source"])


@query("k4_label_agreement", "select s.source, count(*) as n, count(*) filter (where abs(s.vis_m+case when s.station_id%7=0 then 1 else 0 end-r.vis_m)>1e-3) as n_vis_mismatch, count(*) filter (where s.y_cls<>r.y_cls) as n_cls_mismatch from v_pred s join v_pred r on s.sample_id=r.sample_id and r.source='A' and s.source<>'A' group by 1")
def labels(v):
    moved = F.when((F.col("source") != "A") & (F.col("station_id") % 7 == 0), F.col("vis_m") + 1).otherwise(F.col("vis_m"))
    return A.label_agreement(v.v_pred.withColumn("vis_m", moved), "A", ["sample_id"])


_RIGHT = {"zenith": "zenith", "lcc": "lcc+case when h%10=0 then 0.5e0 else 0 end", "cape": "cape*1.00001e0"}


@query("k5_shared_covariate_diff", " union all ".join(f"select '{n}' as name, count(*) as n, count(*) filter (where abs({n}-({x}))>1e-4+1e-5*abs({x})) as n_bad, round(max(abs({n}-({x}))),6) as max_diff, round(avg(abs({n}-({x}))),6) as mean_diff, round(avg({n}),6) as mean_left, round(avg({x}),6) as mean_right from v_met" for n, x in _RIGHT.items()))
def covariates(v):
    names = list(_RIGHT)
    left = v.v_met.select("station_id", "h", *names)
    right = left.selectExpr("station_id", "h", *[f"{x} as {n}" for n, x in _RIGHT.items()])
    out = A.shared_covariate_diff(left, right, ["station_id", "h"], names)
    return out.select("name", "n", "n_bad", *[F.round(c, 6).alias(c) for c in ("max_diff", "mean_diff", "mean_left", "mean_right")])


_CONFIGS = "select source as dataset, cast(12 as varchar(5)) as window_size, case when source='C' then 'v1' else 'v2' end as unit_policy, cast(count(*) % 2 as varchar(5)) as parity from v_pred group by source"


@query("k6_protocol_equality", f"with c as ({_CONFIGS}), l as (select 'window_size' as field, window_size as v from c union all select 'unit_policy', unit_policy from c union all select 'parity', parity from c) select field, count(distinct v) as n_values, string_agg(distinct v, '|' order by v) as found from l group by 1 having count(distinct v)>1")
def protocol(v):
    return A.protocol_equality(v.sql(_CONFIGS), ["window_size", "unit_policy", "parity"])


_SPLIT_MEANS = "select source, case when h<400 then 'train' else 'test' end as split, variable as feature, case when source='B' and h>=400 and variable='MSLP' then value/100 else value end as value from v_units where not (source='A' and variable='Q_1000' and h>=400)"


@query("k7_cross_source_units", f"with m as (select source, split, feature, avg(value) as mean from ({_SPLIT_MEANS}) u group by 1,2,3), e as (select source, split, feature from (select distinct source, split from ({_SPLIT_MEANS}) u) s, (select unnest(['MSLP','Q_1000']) as feature) f) select e.source, e.split, e.feature, case when mean is null then 'missing' else 'mean out of range' end as issue from e left join m using (source, split, feature) where mean is null or not case when e.feature='MSLP' then mean>5e4 and mean<1.2e5 else mean>1e-5 and mean<0.04 end")
def cross_units(v):
    rows = v.sql(_SPLIT_MEANS)
    means = rows.groupBy("source", "split", "feature").agg(F.avg("value").alias("mean"))
    expected = rows.select("source", "split").distinct().withColumn("feature", F.explode(F.array(F.lit("MSLP"), F.lit("Q_1000"))))
    return A.cross_source_units(means, expected)


# Variables as sources hold them: native where some value is there, zero-filled where all values are 0; dew points count as derived.
_HELD = """select source as dataset, variable, count(value) as n, count(*) filter (where value<>0) as k from (
  select source, variable, value from v_units union all select 'C', 'RH_925', rh_frac from v_field union all select 'C', 'CAPE', q_gkg*0 from v_field union all select 'C', 'DPD', t2m_k from v_field) x group by 1,2"""
_DERIVABLE = (("DPD", ("T2M", "RH2M")), ("DP_1000", ("Q_1000",)))
_DERIVED_SQL = " union all ".join(f"select dataset, '{k}' as variable from h where n>0 and variable in ({','.join(repr(x) for x in xs)}) group by 1 having count(*)={len(xs)}" for k, xs in _DERIVABLE)


@query("k8_lineage_rules", f"""with h as ({_HELD}), d as ({_DERIVED_SQL} union all select 'C', 'DPD'), nat as (select dataset, variable from h where n>0),
al as (select * from nat union all select * from d), z as (select dataset, variable from h where n>0 and k=0)
select dataset, 'native and derived: '||string_agg(variable, ',' order by variable) as issue from (select * from nat intersect select * from d) b group by 1
union all select dataset, 'zero-filled: '||string_agg(variable, ',' order by variable) from z group by 1
union all select dataset, 'RH_925 without T_925' from al group by 1 having count(*) filter (where variable='RH_925')>0 and count(*) filter (where variable='T_925')=0
union all select dataset, 'unit policy differs' from h group by 1 having count(*) filter (where variable='CAPE')>0
union all select dataset, 'time isn''t UTC' from h group by 1 having count(*) filter (where variable='RH2M')=0""")
def lineage(v):
    held = v.sql(_HELD)
    names = held.groupBy("dataset").agg(
        F.collect_set(F.when(F.col("n") > 0, F.col("variable"))).alias("native"), F.collect_set(F.when((F.col("n") > 0) & (F.col("k") == 0), F.col("variable"))).alias("zero_filled"),
        F.collect_set("variable").alias("named"),
    )
    has = lambda xs: F.size(F.array_intersect("native", F.array(*[F.lit(x) for x in xs]))) == len(xs)
    given = [F.when(has(xs), F.lit(k)) for k, xs in _DERIVABLE] + [F.when(F.col("dataset") == "C", F.lit("DPD"))]
    derived = F.filter(F.array_distinct(F.array(*given)), lambda x: x.isNotNull())
    configs = names.select(
        "dataset", "native", "zero_filled", derived.alias("derived"), F.when(F.array_contains("named", "CAPE"), "v1").otherwise("v2").alias("unit_policy"),
        F.when(F.array_contains("named", "RH2M"), "UTC").otherwise("local").alias("time_zone"),
    )
    return A.lineage_rules(configs, "v2")


# The new product has the even hours, some values of its own, and a third of its stations elsewhere.
_NEW = "select station_id, h, t2m+case when h%6=0 and station_id%2=0 then 0.5e0 else 0.0e0 end as t2m, mslp from v_met where h%2=0"
_MOVED = "select station_id, lat+case when station_id%3=0 then 0.25e0 else 0.0e0 end as lat, lon from v_station"


@query("k10_product_diff", f"""with t as (select h, row_number() over (order by h) as r, count(*) over () as n from (select distinct h from v_met where h%2=0) a), p as (select h from t where r-1 in (select cast(floor(i*(select max(n)-1 from t)/59.0e0+1e-9) as bigint) from (select unnest(range(60)) as i) z)),
d as (select abs(b.t2m-a.t2m) as t2m, abs(b.mslp-a.mslp) as mslp from v_met a join ({_NEW}) b on a.station_id=b.station_id and a.h=b.h join p on p.h=a.h join v_station s on s.station_id=a.station_id join ({_MOVED}) m on m.station_id=a.station_id and abs(m.lat-s.lat)>1e-6)
select 't2m' as variable, count(*) as n, count(*) filter (where t2m>1e-7) as n_changed, round(max(t2m),6) as max_diff, round(avg(t2m),6) as mean_diff from d union all select 'mslp', count(*), count(*) filter (where mslp>1e-7), round(max(mslp),6), round(avg(mslp),6) from d""")
def product(v):
    old, new = v.v_met.select("station_id", "h", "t2m", "mslp"), v.sql(_NEW)
    only = [A.common_times(old, new, "h", 60), A.changed_stations(v.v_station, v.sql(_MOVED))]
    out = A.product_diff(old, new, ["station_id", "h"], ["t2m", "mslp"], only)
    return out.select("variable", "n", "n_changed", F.round("max_diff", 6).alias("max_diff"), F.round("mean_diff", 6).alias("mean_diff"))


_POP = "select case when h<400 then 'old' else 'new' end as population, name, value from (select station_id, h, 't2m' as name, t2m as value from v_met union all select station_id, h, 'precip', precip from v_met) l"
_POINTS = (1, 5, 50, 95, 99)


@query("k11_feature_shift", f"with p as ({_POP}), s as (select name, quantile_cont(value,0.5) as c, quantile_cont(value,0.95)-quantile_cont(value,0.05) as w from p where population='old' group by 1), z as (select p.*, (value-c)/(w+1e-6) as z from p join s using (name)) select population, name, count(*) as n, round(1.0e0*count(value)/count(*),6) as finite_rate, round(1.0e0*count(*) filter (where value=0)/count(*),6) as zero_rate, " + ", ".join(f"round(quantile_cont(value,{p / 100}),6) as p{p}, round(quantile_cont(z,{p / 100}),6) as z{p}" for p in _POINTS) + ", round(1.0e0*count(*) filter (where abs(z)>3)/count(*),6) as rate_3, round(1.0e0*count(*) filter (where abs(z)>8)/count(*),6) as rate_8 from z group by 1,2")
def shift(v):
    long = v.sql(_POP)
    scaler = robust_scaler(long.filter("population = 'old'"))
    out = A.feature_shift(long, scaler)
    return out.select("population", "name", "n", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("k12_core_shift_summary", f"with p as ({_POP}), s as (select name, quantile_cont(value,0.5) as c, quantile_cont(value,0.95)-quantile_cont(value,0.05) as w from p where population='old' group by 1), z as (select p.population, (value-c)/(w+1e-6) as z from p join s using (name)) select population, count(*) as n, round(quantile_cont(z,0.5),6) as z50, round(quantile_cont(z,0.99),6) as z99, round(1.0e0*count(*) filter (where abs(z)>3)/count(*),6) as rate_3 from z group by 1")
def core(v):
    long = v.sql(_POP)
    out = A.feature_shift(long, robust_scaler(long.filter("population = 'old'")), ["population"])
    return out.select("population", "n", *[F.round(c, 6).alias(c) for c in ("z50", "z99", "rate_3")])


@query("k14_dedupe_sources", "with r as (select source, concat('run', cast(month(valid_time) as varchar(2))) as run_dir, count(*) as n from v_pred group by 1,2), l as (select * from (select *, row_number() over (partition by source order by run_dir desc) as k from r) x where k=1) select source, run_dir, n, row_number() over (order by case source when 'B' then 1 when 'A' then 2 else 3 end, source) as place from l")
def dedupe(v):
    runs = v.v_pred.groupBy("source", F.concat(F.lit("run"), F.month("valid_time").cast("string")).alias("run_dir")).agg(F.count("*").alias("n"))
    return A.dedupe_sources(runs, ["B", "A"])


@query("k15_staged_audit", "select 'structure' as stage, 'warning' as severity, concat('station ', cast(station_id as varchar(20)), ': ', cast(count(*) as varchar(20)), ' hours') as message from v_obs group by station_id having count(*)<60 union all select 'pairing', 'error', concat('source ', source, ' lacks ', cast((select count(distinct sample_id) from v_pred)-count(distinct sample_id) as varchar(20)), ' samples') from v_pred group by source")
def staged(v):
    def structure():
        sparse = v.v_obs.groupBy("station_id").agg(F.count("*").alias("n")).filter("n < 60")
        return sparse.select(F.lit("warning").alias("severity"), F.concat(F.lit("station "), F.col("station_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" hours")).alias("message"))

    def pairing():
        total = v.v_pred.agg(F.count_distinct("sample_id").alias("_t"))  # one row
        per = v.v_pred.groupBy("source").agg(F.count_distinct("sample_id").alias("n")).crossJoin(F.broadcast(total))
        return per.select(F.lit("error").alias("severity"), F.concat(F.lit("source "), "source", F.lit(" lacks "), (F.col("_t") - F.col("n")).cast("string"), F.lit(" samples")).alias("message"))

    def features():
        return A.quality_issues(scan(v)).select(F.lit("error").alias("severity"), F.col("issue").alias("message"))

    return A.staged_audit([("structure", structure), ("pairing", pairing), ("features", features)])


# Every eleventh file is an hour early: two files of one hour, then a gap.
_FILES = "select concat('/p/run', cast(h%3 as varchar(3)), '_lead', cast(case when h%50=0 then 99 else h%24 end as varchar(3)), 'h.nc') as path, h-h%24 as init_h, h-case when h%11=5 then 1 else 0 end as h from v_field"


@query("k16_file_time_check", f"with f as ({_FILES}), p as (select h, count(distinct path) as p, count(*) filter (where cast(regexp_extract(path,'lead(\\d+)h',1) as bigint)<>h-init_h) as b from f group by 1), d as (select *, h-lag(h) over (order by h) as d from p) select count(*) filter (where p>1) as n_repeated, count(*) filter (where d<>1) as n_irregular, cast(sum(b) as bigint) as n_lead_mismatch from d")
def file_times(v):
    return A.file_time_check(v.sql(_FILES))
