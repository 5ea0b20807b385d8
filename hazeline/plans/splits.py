"""Queries of splits, samples and donors."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.operators import normalise as N
from hazeline.operators import series as S
from hazeline.operators import splits as P
from hazeline.registry import query
from hazeline.sources.sinks import stored

_SPLIT = """case when dim-10<1 then null when d>=dim-2 then 'test' when d between dim-6 and dim-4 then 'val' when d<=dim-8 then 'train' end"""
_DAYS = f"(select *, {_SPLIT} as split from (select source, sample_id, valid_time, day(valid_time) as d, day(last_day(valid_time)) as dim from v_pred) a)"


def split(v):
    return v.v_pred.select("source", "sample_id", "station_id", "valid_time", P.month_tail_split(F.col("valid_time")).alias("split"))


@query("h1_month_tail_split", f"select source, sample_id, split from {_DAYS} s")
def tails(v):
    return split(v).select("source", "sample_id", "split")


@query("h2_split_leakage", f"select station_id, count(distinct split) as n_splits from (select station_id, {_SPLIT} as split from (select station_id, day(valid_time) as d, day(last_day(valid_time)) as dim from v_pred) a) b group by 1 having count(distinct split)>1")
def leakage(v):
    return P.split_leakage(split(v), ["station_id"])


@query("h3_merge_train_val", f"select source, case when split in ('train','val') then 'train' else split end as split, count(*) as n from {_DAYS} s group by 1,2")
def merged(v):
    return P.merge_splits(split(v), ["train", "val"], "train").groupBy("source", "split").agg(F.count("*").alias("n"))


_DRAW = lambda s, k: f"cast(('0x'||substr(md5('{s}|'||{k}),1,8))::UBIGINT as bigint)"


@query("h4_uniform_sample", f"select source, sample_id from (select source, sample_id, row_number() over (partition by source order by {_DRAW('7', 'sample_id')}, sample_id) as k from v_pred) s where k<=500")
def uniform(v):
    return P.uniform_sample(v.v_pred, ["sample_id"], 500, "7", by=["source"]).select("source", "sample_id")


@query("h5_even_sample", "with k as (select x, row_number() over (order by x) as r, count(*) over () as n from (select distinct l_extendedprice as x from lineitem) a) select x from k where r-1 in (select cast(floor(i*(select max(n)-1 from k)/100.0e0+1e-9) as bigint) from (select unnest(range(101)) as i) z)")
def even(v):
    return P.even_sample(v.table("lineitem").select(F.col("l_extendedprice").alias("x")), "x", 101)


@query("h6_class_balanced_sample", f"""with r as (select source, y_cls, sample_id, row_number() over (partition by source, y_cls order by {_DRAW('3', 'sample_id')}, sample_id) as k, count(*) over (partition by source, y_cls) as n from v_pred),
s as (select b.batch, t.slot, case when slot<12 then 0 when slot<26 then 1 else 2 end as y_cls, cast(('0x'||substr(md5('3|'||cast(b.batch as varchar)||'|'||cast(t.slot as varchar)),1,8))::UBIGINT as bigint) as d from (select unnest(range(50)) as batch) b cross join (select unnest(range(64)) as slot) t)
select r.source, s.batch, s.slot, s.y_cls, r.sample_id from s join r on r.y_cls=s.y_cls and r.k=s.d % r.n + 1""")
def balanced(v):
    return P.class_balanced_sample(v.v_pred, "sample_id", 50, 64, "3", by=["source"])


def _donor(rows: str, seed: str, strata: str) -> str:
    return f"""select a.source, a.sample_id, b.sample_id as donor from (select *, row_number() over (partition by source, {strata} order by {_DRAW('order', 'sample_id')}, sample_id) as r from {rows} x) a
  join (select *, row_number() over (partition by source, {strata} order by {_DRAW(seed, 'sample_id')}, sample_id) as r from {rows} x) b on a.r=b.r and a.source=b.source and a.{strata}=b.{strata}"""


_MARGINAL = _donor("(select source, sample_id, 1 as g from v_pred)", "5", "g")


@query("h7_marginal_donor", _MARGINAL)
def marginal(v):
    return P.donors(v.v_pred, "sample_id", "5", ["source"])


@query("h7_moved_fraction", f"select source, count(*) as n, round(avg(case when sample_id<>donor then 1.0e0 else 0.0e0 end),6) as moved_fraction from ({_MARGINAL}) m group by source")
def moved(v):
    return P.donor_summary(marginal(v), "sample_id", ["source"]).withColumn("moved_fraction", F.round("moved_fraction", 6))


_STRATA = "(select source, sample_id, concat(cast(month(valid_time) as varchar(3)),'-',cast(station_id as varchar(20)),'-',cast(day(valid_time) as varchar(3))) as g, cast(month(valid_time) as varchar(3)) as c from v_pred)"


def stratified_sql(rows: str, seed: str) -> str:
    """Donors of rows (source, sample_id, g, c), as a query that starts with `with`."""
    return f"""with s as {rows}, n as (select *, count(*) over (partition by source, g) as k from s), m as (select * from n where k>1), o as (select source, sample_id, c as g, count(*) over (partition by source, c) as k from n where k=1)
select *, 'fine' as level from ({_donor('m', seed, 'g')}) f union all select *, 'coarse' from ({_donor('(select * from o where k>1)', seed, 'g')}) c union all select source, sample_id, sample_id, 'none' from o where k=1"""


_STRATIFIED = stratified_sql(_STRATA, "9")


@query("h8_stratified_donor", _STRATIFIED)
def stratified(v):
    t = F.col("valid_time")
    fine = F.concat_ws("-", F.month(t).cast("string"), F.col("station_id").cast("string"), F.dayofmonth(t).cast("string"))
    df = v.v_pred.select("source", "sample_id", fine.alias("g"), F.month(t).cast("string").alias("c"))
    return P.stratified_donors(df, "sample_id", "9", ["g"], ["c"], by=["source"])


# Strata as the survey has them: season, 6 hours, boxes of 10 degrees and the quartile by source of an anchor, here standing for the
# moisture of the air; v_pred has dates alone, so all hours are of one bin.
_EDGES = "select source, list_distinct([" + ",".join(f"quantile_cont(p_fog,{i / 4})" for i in range(5)) + "]) as e, count(*) as n from v_pred group by source"
_SURVEYED = f"""(select source, sample_id, concat_ws('-', season, bin, la, lo, code) as g, concat_ws('-', season, bin, code) as c from (
  select p.source, sample_id, (month(valid_time)%12)//3 as season, 0 as bin, cast(floor(lat/10) as int) as la, cast(floor(lon/10) as int) as lo,
    case when e.n<4 or len(e.e)<=2 then -1 else len(list_filter(list_sort(e.e)[2:len(e.e)-1], lambda x: x<p_fog)) end as code
  from v_pred p join v_station s on s.station_id=p.station_id%(select max(station_id)+1 from v_station) join ({_EDGES}) e on e.source=p.source) z)"""


@query("h8_survey_strata", stratified_sql(_SURVEYED, "5"))
def survey_strata(v):
    n = v.v_station.agg((F.max("station_id") + 1).alias("_s"))  # one row
    placed = v.v_pred.crossJoin(F.broadcast(n)).withColumn("station_id", F.col("station_id") % F.col("_s")).join(v.v_station, "station_id")
    df = P.with_strata(placed, "valid_time", {"Q_1000": F.col("p_fog")})
    fine, coarse = P.strata_of(P.anchor_of(["T2M"], ["Q_1000", "T2M"]))
    coded = stored(df.select("source", "sample_id", *fine), "strata")
    return P.stratified_donors(coded, "sample_id", "5", fine, coarse, by=["source"])


@query("h8_moved_fraction", f"with f as (select * from ({_STRATIFIED}) d) select source, count(*) as n, round(avg(case when sample_id<>donor then 1.0e0 else 0.0e0 end),6) as moved_fraction, round(avg(case when level<>'fine' then 1.0e0 else 0.0e0 end),6) as fallback_fraction from f group by source")
def moved_stratified(v):
    out = P.donor_summary(stratified(v), "sample_id", ["source"])
    return out.withColumns({c: F.round(c, 6) for c in ("moved_fraction", "fallback_fraction")})


@query("h9_quantile_code", "with e as (select list_distinct([" + ",".join(f"quantile_cont(rh_frac,{i / 4})" for i in range(5)) + "]) as e from v_field), s as (select list_sort(e) as e from e) select station_id, h, cast(case when rh_frac is null then -1 else len(list_filter(e[2:len(e)-1], lambda x: x<rh_frac)) end as int) as code from v_field, s")
def codes(v):
    return P.quantile_code(v.v_field, "rh_frac").select("station_id", "h", "code")


@query("b12_pack_row", """with a as (select station_id, h, list(t2m) over l as xs, list(mslp) over l as ys, h-lag(h,11) over w as span, row_number() over w as r, lcc from v_met window w as (partition by station_id order by h), l as (partition by station_id order by h rows between 11 preceding and current row)),
f as (select * from a where len(xs)=12 and span=11)
select station_id, h, name, cast(i-12 as int) as lag, case when name='t2m' then xs[i] else ys[i] end as value from f, (select unnest(range(1,13)) as i) k, (select unnest(['t2m','mslp']) as name) n""")
def packed(v):
    w = S.sliding_window(v.v_met.select("station_id", "h", "t2m", "mslp", "lcc"), ["t2m", "mslp"])
    flat = w.select("station_id", "h", N.pack_row(F.col("win"), ["t2m", "mslp"], [F.col("lcc")]).alias("row"))
    return N.unpack_row(flat, "row", ["station_id", "h"], ["t2m", "mslp"])
