"""Domain views over the given tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_obs": """
select user_id as station_id, cast((day(ts)-1)*24+hour(ts) as bigint) as h, max(value)*40.0e0 as vis_m
from events group by user_id, cast((day(ts)-1)*24+hour(ts) as bigint)""",
    "v_station": """
select station_id, 18.0e0+((station_id*37)%300)/10.0e0 as lat, 75.0e0+((station_id*53)%550)/10.0e0 as lon
from (select distinct user_id as station_id from events) u""",
    "v_spine": """
select station_id, h from (select distinct user_id as station_id from events) a
cross join (select distinct cast((day(ts)-1)*24+hour(ts) as bigint) as h from events) b""",
    "v_field": """
select station_id, h, 273.0e0+((station_id*7+h*13)%97)/4.0e0 as t2m_k, 1000.0e0+((station_id*3+h*5)%41) as mslp_hpa,
  ((station_id*11+h*17)%81-40)/4.0e0 as u10, ((station_id*5+h*19)%81-40)/4.0e0 as v10, 2.0e0+((station_id*13+h*7)%64)/4.0e0 as q_gkg,
  case when (station_id+h)%50=0 then null else ((station_id*17+h*3)%64)/64.0e0 end as rh_frac,
  cast((h%12)*((station_id%4)+1) as double)/8.0e0 as precip_acc
from v_spine""",
    # A cell a part: the box stays, the spacing shrinks with the number of parts. The rectangle is full: its rows are the largest
    # divisor of that number up to sqrt(n/1.25) (40 x 50 cells for 2,000, 125 x 160 for 20,000).
    "v_grid": """
select gi, gj, 17.0e0+gi*(30.0e0/gr) as lat, 74.0e0+gj*(56.25e0/gc) as lon, elev_m, veg
from (select cast(floor(p_partkey/(gc*1.0e0)) as int) as gi, cast(p_partkey%gc as int) as gj, p_size*20.0e0+(p_partkey%97) as elev_m, 1+p_size%20 as veg, gr, gc
  from part cross join (select max(p_partkey) as gr, cast(max(m)/max(p_partkey) as bigint) as gc
    from part cross join (select max(p_partkey)+1 as m from part) a where p_partkey>0 and p_partkey*p_partkey*1.25e0<=m and m%p_partkey=0) k) g""",
    "v_pred": """
select source, sample_id, station_id, valid_time, y_cls, vis_m, w0/(w0+w1+w2) as p_fog, w1/(w0+w1+w2) as p_mist, w2/(w0+w1+w2) as p_clear
from (select src as source, concat(cast(l_orderkey as varchar(20)),'-',cast(l_linenumber as varchar(20)),'-',
    cast(l_partkey as varchar(20)),'-',cast(l_suppkey as varchar(20))) as sample_id, l_suppkey as station_id, l_shipdate as valid_time,
    case when l_quantity*30<500 then 0 when l_quantity*30<1000 then 1 else 2 end as y_cls, l_quantity*30.0e0 as vis_m,
    1.0e0+(l_partkey+k)%7+case when l_quantity*30<500 then 4 else 0 end as w0,
    1.0e0+(l_suppkey+k*3)%5+case when l_quantity*30>=500 and l_quantity*30<1000 then 3 else 0 end as w1,
    1.0e0+(l_orderkey+k*5)%9+case when l_quantity*30>=1000 then 6 else 0 end as w2
  from lineitem cross join (select 'A' as src, 1 as k, 10 as m union all select 'B',2,7 union all select 'C',3,11) c
  where l_orderkey%m<>0) z""",
    # Two sources of one field in different units, a row a variable.
    "v_units": """
select source, station_id, h, variable, value from (
  select 'A' as source, station_id, h, 'T2M' as variable, t2m_k as value from v_field
  union all select 'B', station_id, h, 'T2M', t2m_k-273.0e0 from v_field
  union all select 'A', station_id, h, 'MSLP', mslp_hpa from v_field
  union all select 'B', station_id, h, 'MSLP', mslp_hpa*100.0e0 from v_field
  union all select 'A', station_id, h, 'Q_1000', q_gkg from v_field
  union all select 'B', station_id, h, 'Q_1000', q_gkg/1024.0e0 from v_field
  union all select 'A', station_id, h, 'RH2M', rh_frac from v_field
  union all select 'B', station_id, h, 'RH2M', rh_frac*100.0e0 from v_field) u""",
    # Aerosol in the encodings that occur, some values missing, negative or too large.
    "v_pm": """
select source, station_id, h, declared_units, pm10 from (
  select 'raw' as source, station_id, h, 'ug m-3' as declared_units, case when h%31=0 then null else ((station_id*5+h*3)%160)/1.0e9 end as pm10 from v_spine
  union all select 'legacy', station_id, h, 'legacy_kgm3_times_1e12', ((station_id*5+h*3)%160)*1000.0e0 from v_spine
  union all select 'micro', station_id, h, 'ug m-3',
    case when h%29=0 then -999.0e0 when h%37=0 then 20000.0e0 else ((station_id*5+h*3)%160)*1.0e0 end from v_spine) p""",
    # All dynamic slots of a station series.
    "v_met": """
select station_id, h, 50.0e0+((station_id*17+h*3)%50) as rh2m, 270.0e0+((station_id*7+h*13)%97)/4.0e0 as t2m,
  ((station_id*3+h*7)%16)/8.0e0 as precip, 100000.0e0+((station_id*3+h*5)%41)*64.0e0 as mslp, ((station_id*2+h*11)%64)*8.0e0 as sw_rad,
  ((station_id*11+h*17)%81-40)/4.0e0 as u10, ((station_id*5+h*19)%81-40)/4.0e0 as v10, ((station_id*13+h*23)%64)/4.0e0 as wspd10,
  ((station_id*19+h*29)%360)*1.0e0 as wdir10, ((station_id*29+h*31)%512)*2.0e0 as cape, ((station_id*3+h*13)%64)/64.0e0 as lcc,
  272.0e0+((station_id*5+h*11)%89)/4.0e0 as t_925, 40.0e0+((station_id*23+h*5)%60) as rh_925, ((station_id*7+h*3)%97-48)/4.0e0 as u_925,
  ((station_id*9+h*7)%97-48)/4.0e0 as v_925, ((station_id*11+h*5)%96)/4.0e0 as wspd925, 265.0e0+((station_id*3+h*17)%64)/4.0e0 as dp_1000,
  262.0e0+((station_id*5+h*23)%64)/4.0e0 as dp_925, (2.0e0+((station_id*13+h*7)%64)/4.0e0)/1024.0e0 as q_1000,
  (1.0e0+((station_id*7+h*5)%64)/4.0e0)/1024.0e0 as q_925, ((station_id*3+h*2)%33-16)/32.0e0 as w_925, ((station_id*2+h*3)%33-16)/32.0e0 as w_1000,
  ((station_id*7+h*3)%40)/4.0e0 as dpd, ((station_id*3+h*7)%41-20)/4.0e0 as inversion, ((h%24)*15-180)*((h%24)*15-180)/180.0e0 as zenith
from v_spine""",
}
_TABLES = ("events", "lineitem", "orders", "part", "embeddings", "labels")


#: Views whose plan Spark must be told. Stations are a few bytes each, so adaptive execution would merge them into one task, and the
#: join with the hours would leave all rows of the series in it: they are dealt to {n} tasks, a station in one, and the
#: hours of the month are broadcast.
_SPREAD = {
    "v_spine": """
select /*+ broadcast(b) */ station_id, h from (select distinct user_id as station_id from (select /*+ repartition({n}, user_id) */ user_id from events) e) a
cross join (select distinct cast((day(ts)-1)*24+hour(ts) as bigint) as h from events) b""",
}


def _needed(text: str) -> list[str]:
    out: list[str] = []
    for name in re.findall(r"\bv_[a-z]+\b", text):
        if name in VIEWS and name not in out:
            out = [*out, *[x for x in _needed(VIEWS[name]) if x not in out], name]
    return out


def with_views(sql: str, views: Mapping[str, str] = VIEWS) -> str:
    """sql with the views that it names as common table expressions in front; it may start with `with`."""
    ctes = [f"{name} as ({views[name]})" for name in _needed(sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"


#: HotSpot runs methods of more than 8,000 bytes of code without compiling them. Stages of many columns generate longer ones; under
#: this limit Spark runs such a stage operator by operator, in short methods. The setting is the session's; one made by hand stays.
_METHOD = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


class Data:
    """The views and tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        name, default, limit = _METHOD
        if spark.conf.get(name) == default:
            spark.conf.set(name, limit)

    @property
    def tasks(self) -> int:
        """The number of tasks that a table which a join expands is dealt to."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text, VIEWS | {name: x.format(n=self.tasks) for name, x in _SPREAD.items()})
        for name in _TABLES:
            full = re.sub(rf"(\bfrom\s+){name}\b", rf"\1parquet.`{self.dir}/{name}.parquet`", full)
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)
