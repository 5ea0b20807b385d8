"""Queries of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hazeline.functions.physics import visibility_class
from hazeline.operators import align as A
from hazeline.operators import derive as D
from hazeline.operators import series as S
from hazeline.registry import query

# Minutes of January; every odd hour is 35 minutes late on the left (some ties), ten hours in 240 are far off the axis on the right (no match).
_L = "select station_id, h*60+(h%2)*35 as t, t2m_k from v_field"
_R = "select station_id, h*60+(h%5)*10-20+case when h%240>=230 then 100000 else 0 end as t, case when h%5=0 then null else q_gkg end as q from v_field"
_ASOF = """c as (select l.t, r.t as r, row_number() over (partition by l.t order by abs(l.t-r.t), r.t desc) as k from (select distinct t from l) l join (select distinct t from r) r on abs(l.t-r.t)<=90),
m as (select t, r as match from c where k=1)"""


@query("e1_asof_nearest", f"with l as ({_L}), r as ({_R}), {_ASOF} select l.station_id, l.t, l.t2m_k, m.match, r.q from l left join m on m.t=l.t left join r on r.t=m.match and r.station_id=l.station_id")
def asof(v):
    return A.asof_nearest(v.sql(_L), v.sql(_R), ["station_id"], 90).select("station_id", "t", "t2m_k", "match", "q")


_L2 = _L.replace("t2m_k", "q_gkg*2 as q")


@query("e2_override_field", f"with l as ({_L2}), r as ({_R}), {_ASOF} select l.station_id, l.t, coalesce(r.q, l.q) as q from l left join m on m.t=l.t left join r on r.t=m.match and r.station_id=l.station_id")
def override(v):
    return A.override_field(v.sql(_L2), v.sql(_R), "q", ["station_id"], 90).select("station_id", "t", "q")


@query("e3_station_reindex", "select o.station_id, o.h, o.vis_m, s.lat, s.lon from v_obs o join v_station s on s.station_id=o.station_id")
def reindex(v):
    return A.station_reindex(v.v_obs, v.v_station).select("station_id", "h", "vis_m", "lat", "lon")


@query("e4_common_stations", "select station_id, h, vis_m from v_obs where station_id in (select station_id from v_station where station_id%3<>0)")
def common(v):
    return A.common_stations(v.v_obs, v.v_station.filter("station_id % 3 <> 0"))


@query("e5_canonical_coords", "select station_id, case when station_id%2=0 then lat+0.5e0 else lat end as lat, case when station_id%2=0 then lon-0.5e0 else lon end as lon from v_station")
def coords(v):
    target = v.v_station.filter("station_id % 2 = 0").withColumns({"lat": F.col("lat") + 0.5, "lon": F.col("lon") - 0.5})
    return A.canonical_coordinates(v.v_station, target, v.v_station)


_LOOK = "select h, station_id, case when h%4=0 then null else vis_m end as vis from v_obs where h%3<>0"


@query("e6_exact_lookup", f"select f.station_id, f.h, l.vis is not null as valid, case when l.vis is null then -1 when vis<500 then 0 when vis<1000 then 1 else 2 end as lookup_cls from v_field f left join ({_LOOK}) l on l.h=f.h and l.station_id=f.station_id")
def lookup(v):
    return A.exact_lookup(v.v_field, v.sql(_LOOK), ["h", "station_id"], "vis", visibility_class).select("station_id", "h", "valid", "lookup_cls")


@query("e7_paired_intersection", "select source, sample_id, y_cls from v_pred where sample_id in (select sample_id from v_pred group by sample_id having count(distinct source)=3)")
def intersection(v):
    return A.paired_intersection(v.v_pred.select("source", "sample_id", "y_cls"), ["sample_id"], 3)


@query("k9_pairing_coverage", "with f as (select sample_id, count(distinct source)=3 as c from v_pred group by 1) select source, count(*) as n_rows, count(*) filter (where c) as n_common, round(1.0e0*count(*) filter (where c)/count(*),6) as fraction from v_pred join f using (sample_id) group by 1")
def coverage(v):
    return A.pairing_coverage(v.v_pred, ["sample_id"], 3).withColumn("fraction", F.round("fraction", 6))


_ITEM = "select l_orderkey as k, l_partkey as p, l_suppkey as s, l_extendedprice as e, l_quantity as q, l_shipdate as d, l_linenumber as n from lineitem"
_ORD = "n, p, s, d, e, q"


@query("e8_pair_with_duplicates", f"""with a as (select *, row_number() over (partition by k order by {_ORD})-1 as occ from ({_ITEM}) x where q<30), b as (select *, row_number() over (partition by k order by {_ORD})-1 as occ from ({_ITEM}) x where q>=30)
select a.k, a.occ, a.p, b.p as r_p from a join b on a.k=b.k and a.occ=b.occ""")
def occurrences(v):
    df = v.sql(_ITEM)
    out = A.pair_with_duplicates(df.filter("q < 30"), df.filter("q >= 30"), ["k"], ["n", "p", "s", "d", "e", "q"])
    return out.select("k", "occ", "p", "r_p")


@query("f7_occurrence_number", f"select k, p, s, row_number() over (partition by k order by {_ORD})-1 as occ from ({_ITEM}) x")
def occurrence(v):
    return A.with_occurrence(v.sql(_ITEM), ["k"], ["n", "p", "s", "d", "e", "q"]).select("k", "p", "s", "occ")


@query("e9_align_to_reference", """with n as (select source, station_id, valid_time, sample_id, row_number() over (partition by source, station_id, valid_time order by sample_id)-1 as occ from v_pred),
f as (select station_id, valid_time, occ from n group by 1,2,3 having count(distinct source)=3 and max(case when source='B' then 1 else 0 end)=1)
select n.source, n.station_id, n.occ, n.sample_id from n join f on f.station_id=n.station_id and f.valid_time=n.valid_time and f.occ=n.occ""")
def aligned(v):
    rows = v.v_pred.select("source", "station_id", "valid_time", "sample_id")
    return A.align_to_reference(rows, "B", ["station_id", "valid_time"], ["sample_id"], 3).select("source", "station_id", "occ", "sample_id")


_CELL = """a as (select station_id, gi, row_number() over (partition by station_id order by abs(g.lat-s.lat), gi) as k from v_station s, (select gi, min(lat) as lat from v_grid group by gi) g),
b as (select station_id, gj, row_number() over (partition by station_id order by abs(g.lon-s.lon), gj) as k from v_station s, (select gj, min(lon) as lon from v_grid group by gj) g),
c as (select a.station_id, gi, gj from a join b on a.station_id=b.station_id and a.k=1 and b.k=1)"""


@query("e10_nearest_cell", f"with {_CELL} select c.station_id, c.gi, c.gj, g.veg from c left join v_grid g on g.gi=c.gi and g.gj=c.gj")
def cell(v):
    cells = A.nearest_cell(v.v_station, v.v_grid)
    return cells.select("station_id", "gi", "gj").join(v.v_grid.select("gi", "gj", "veg"), ["gi", "gj"], "left")


_TERRAIN = f"""{_CELL}, t as (select c.station_id, max(case when g.gi=c.gi and g.gj=c.gj then elev_m end) as elev_m, avg(elev_m) as m, stddev_pop(elev_m) as s
  from c join v_grid g on abs(g.gi-c.gi)<=2 and abs(g.gj-c.gj)<=2 group by 1)"""


@query("e11_neighbourhood_stats", f"with {_TERRAIN} select station_id, elev_m, round(elev_m-m,6) as deviation, round(s,6) as spread from t")
def terrain(v):
    out = A.neighbourhood_stats(A.nearest_cell(v.v_station, v.v_grid), v.v_grid, "elev_m")
    return out.select("station_id", "elev_m", F.round("deviation", 6).alias("deviation"), F.round("spread", 6).alias("spread"))


@query("d10_static_features", f"with {_TERRAIN} select s.station_id, round(s.lat/90,9) as lat_n, round(s.lon/180,9) as lon_n, t.elev_m, round(t.elev_m-t.m,6) as elev_dev_m, round(t.s,6) as elev_std_m, cast(case when g.veg<=16 then g.veg-1 when g.veg between 18 and 20 then g.veg-2 else 0 end as int) as veg_idx from v_station s join t on t.station_id=s.station_id join c on c.station_id=s.station_id join v_grid g on g.gi=c.gi and g.gj=c.gj")
def static(v):
    cells = A.nearest_cell(v.v_station, v.v_grid)
    ground = A.neighbourhood_stats(cells, v.v_grid, "elev_m").select("station_id", "elev_m", F.col("deviation").alias("elev_dev_m"), F.col("spread").alias("elev_std_m"))
    out = D.static_features(v.v_station, cells.join(v.v_grid.select("gi", "gj", "veg"), ["gi", "gj"]), ground)
    places = {"lat_n": 9, "lon_n": 9, "elev_dev_m": 6, "elev_std_m": 6}
    return out.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in out.columns])


_KNN = """d as (select station_id, gi, gj, sqrt(pow(g.lat-s.lat,2)+pow(g.lon-s.lon,2)) as d from v_station s, v_grid g),
n as (select *, row_number() over (partition by station_id order by d, gi, gj) as r, 1/pow(greatest(d,1e-6),2) as w from d)"""
_GF = "select gi, gj, t, case when (gi+gj+t)%17=0 then null else elev_m+t*10.0e0 end as x from v_grid cross join (select distinct h as t from v_spine) k"


def _field(v):
    """The rows of _GF: cells are dealt to tasks by place and the hours broadcast, so that a join by place doesn't move the field."""
    grid = v.v_grid.select("gi", "gj", "elev_m").repartition(v.tasks, "gi", "gj")
    hours = F.broadcast(v.v_spine.select(F.col("h").alias("t")).distinct())  # a row an hour of the month
    value = F.when((F.col("gi") + F.col("gj") + F.col("t")) % 17 != 0, F.col("elev_m") + F.col("t") * 10.0)
    return grid.crossJoin(hours).select("gi", "gj", "t", value.alias("x"))


@query("e12_idw_knn", f"with {_KNN}, q as (select *, w/sum(w) over (partition by station_id) as wn from n where r<=4), f as ({_GF}) select t, station_id, round(case when count(x)>=4 then sum(wn*x) end,6) as x from f join q on q.gi=f.gi and q.gj=f.gj group by 1,2")
def knn(v):
    out = A.idw_knn(A.knn_weights(v.v_station, v.v_grid), _field(v), ["t"], "x")
    return out.select("t", "station_id", F.round("x", 6).alias("x"))


@query("e13_idw_radius", f"""with {_KNN.split("n as")[0].rstrip().rstrip(",")}, f as ({_GF}), m as (select t, avg(x) as mean, count(x) as cells from f group by 1),
b as (select * from (select f.t, d.station_id, d.d, f.x, row_number() over (partition by f.t, d.station_id order by d.d, f.gi, f.gj) as r from f join d on d.gi=f.gi and d.gj=f.gj where x is not null and d.d<=5) z where r<=10),
o as (select t, station_id, coalesce(avg(case when d<0.01 then x end), sum(x/pow(greatest(d,1e-12),2))/sum(1/pow(greatest(d,1e-12),2))) as x from b group by 1,2)
select m.t, s.station_id, round(case when cells>=4 then coalesce(x,mean) else coalesce(mean,0) end,6) as x from m cross join v_station s left join o on o.t=m.t and o.station_id=s.station_id""")
def radius(v):
    out = A.idw_radius(v.v_station, v.v_grid, _field(v), ["t"], "x")
    return out.select("t", "station_id", F.round("x", 6).alias("x"))


_LEVELS = "select station_id, h, lev, q_gkg*lev as x from v_field cross join (select 850.0e0 as lev union all select 900.0e0 union all select 950.0e0 union all select 1000.0e0) l"


@query("e14_level_select", f"select station_id, h, lev, x from (select *, row_number() over (partition by station_id, h order by abs(lev-925), lev) as k from ({_LEVELS}) l) r where k=1")
def level(v):
    return A.level_select(v.sql(_LEVELS), ["station_id", "h"], "lev", 925.0, "x")


# Hours 100 to 103 lie off the axis (no file), every fifth value is missing.
_RUNS = "select h-h%24-case when h%24<12 then 12 else 0 end as init_h, h+case when h between 100 and 103 then 1000 else 0 end as valid_h, station_id, case when h%5=0 then null else t2m_k end as t2m_k from v_field"


@query("e15_cycle_stitch", f"with r as ({_RUNS}) select s.h, s.h-s.h%24-case when s.h%24<12 then 12 else 0 end as init_h, s.h%24+case when s.h%24<12 then 12 else 0 end as lead, r.station_id, r.t2m_k from (select distinct h from v_spine) s left join r on r.valid_h=s.h")
def stitch(v):
    return A.cycle_stitch(v.v_spine.select("h").distinct(), v.sql(_RUNS)).select("h", "init_h", "lead", "station_id", "t2m_k")


@query("e15_stitch_counts", f"with r as ({_RUNS}), s as (select r.station_id, r.t2m_k from (select distinct h from v_spine) s left join r on r.valid_h=s.h) select 'station_id' as variable, count(station_id) as n_ok, count(*)-count(station_id) as n_miss from s union all select 't2m_k', count(t2m_k), count(*)-count(t2m_k) from s")
def stitch_counts(v):
    return A.stitch_counts(A.cycle_stitch(v.v_spine.select("h").distinct(), v.sql(_RUNS)), ["station_id", "t2m_k"])


@query("e16_station_set_diff", "select station_id, case when station_id%3=0 then 'missing' when station_id%5=0 then 'extra' else 'common' end as status from v_station")
def diff(v):
    return A.station_set_diff(v.v_station.filter("station_id % 3 <> 0"), v.v_station.filter("station_id % 5 <> 0 or station_id % 3 = 0"))


@query("e17_coordinate_check", "select max(abs(cast(lat+case when station_id%4=0 then 0.25e0 else 0 end as float)-cast(lat as float))) as max_lat, cast(0 as float) as max_lon, count(*) filter (where station_id%4=0) as n_changed from v_station")
def check(v):
    moved = v.v_station.withColumn("lat", F.col("lat") + F.when(F.col("station_id") % 4 == 0, 0.25).otherwise(0.0))
    return A.coordinate_check(moved, v.v_station)


_SWAP = lambda c, d: f"case when variant in ('{c}','all') then {d} else f.{c} end"


@query("e18_donor_swap", """with f as (select station_id, h, u10, v10 from v_met), w as (select a.station_id, a.h, k.lag, l.u10, l.v10, l.h as lh from f a join (select unnest(range(-11,1)) as lag) k on true join f l on l.station_id=a.station_id and l.h=a.h+k.lag),
full_w as (select station_id, h from w group by 1,2 having count(*)=12)
select w.station_id, w.h, variant, round(sum(case when variant in ('u10','all') then w.v10 else w.u10 end*(lag+12)),6) as u, round(sum(case when variant in ('v10','all') then w.u10 else w.v10 end*(lag+12)),6) as v
from w join full_w using (station_id, h), (select unnest(['u10','v10','all']) as variant) x group by 1,2,3""")
def swap(v):
    base = v.v_met.select("station_id", "h", "u10", "v10")
    donor = v.v_met.select("station_id", "h", F.col("v10").alias("u10"), F.col("u10").alias("v10"))
    out = A.donor_swap(base, donor, ["u10", "v10"])
    # Written out: lambdas of aggregate and transform aren't compiled.
    total = lambda c: F.round(reduce(lambda a, b: a + b, [F.get(c, F.lit(i)) * (i + 1) for i in range(S.STEPS)]), 6)
    return out.select("station_id", "h", "variant", total("u10").alias("u"), total("v10").alias("v"))
