"""Deriving the fields that a source lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions import physics as P


def precip_increment(df: DataFrame, value: str, station: str = "station_id", time: str = "h") -> DataFrame:
    """Amounts of each step of an accumulated series: where it drops it was reset and the value itself counts; the
    first step has 0."""
    x = F.col(value)
    d = x - F.lag(x).over(Window.partitionBy(station).orderBy(time))
    return df.withColumn(value, P.clip(F.when(d.isNull() & x.isNotNull(), 0.0).when(d < 0, x).otherwise(d), low=0.0))


def solar_zenith(df: DataFrame, station: str, time: str, day: Column, hour: Column) -> DataFrame:
    """df with ZENITH, computed once for each station and hour."""
    axis = df.groupBy(station, time).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    angle = P.solar_zenith(day, hour, F.col("lat"), F.col("lon"))
    return df.join(axis.select(station, time, angle.alias("ZENITH")), [station, time])


def derive_fields(df: DataFrame) -> DataFrame:
    """Adds what can be derived and is missing, in the order RH2M, winds, Q, DP, DPD, INVERSION.

    A given dew point stays; humidity columns are made from T and RH where absent.
    """
    def has(*names: str) -> bool:
        return all(n in df.columns for n in names)

    def fill(name: str, value: Column) -> None:
        nonlocal df
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)

    c = F.col
    if has("T2M", "D2M"):
        fill("RH2M", P.rh_from_dewpoint(c("T2M"), c("D2M")))
    if has("U10", "V10"):
        df = df.withColumns({"WSPD10": P.wind_speed(c("U10"), c("V10")), "WDIR10": P.wind_direction(c("U10"), c("V10"))})
    if has("U_925", "V_925"):
        df = df.withColumn("WSPD925", P.wind_speed(c("U_925"), c("V_925")))
    for level in (1000, 925):
        t, rh, q, dp = f"T_{level}", f"RH_{level}", f"Q_{level}", f"DP_{level}"
        if has(t, rh):
            fill(q, P.q_from_t_rh(c(t), c(rh), float(level)))
        if has(q):
            fill(dp, P.dewpoint_from_q(c(q), float(level)))
    if has("T2M", "D2M"):
        fill("DPD", c("T2M") - c("D2M"))
    elif has("T2M", "RH2M"):
        fill("DPD", c("T2M") - P.dewpoint_from_rh(c("T2M"), c("RH2M")))
    if has("T_925", "T2M"):
        fill("INVERSION", c("T_925") - c("T2M"))
    return df


def contrasts(df: DataFrame) -> DataFrame:
    """DPD, INVERSION and Q1000 - Q925 from their parts."""
    c = F.col
    return df.withColumns({"DPD": c("T2M") - c("D2M"), "INVERSION": c("T_925") - c("T2M"), "Q1000_MINUS_Q925": c("Q_1000") - c("Q_925")})


#: Vegetation ids in index order (fixed values).
VEGETATION = (*range(1, 17), 18, 19, 20)


def static_features(stations: DataFrame, cells: DataFrame, terrain: DataFrame) -> DataFrame:
    """station_id with lat/90, lon/180, elevation, its deviation and spread around, and the vegetation index.

    cells: station_id, veg of the nearest cell; terrain: station_id, elev_m, elev_dev_m, elev_std_m.
    """
    index = F.array_position(F.array(*[F.lit(i) for i in VEGETATION]), F.col("veg")) - 1
    both = stations.join(cells.select("station_id", "veg"), "station_id").join(terrain, "station_id")
    return both.select(
        "station_id", (F.col("lat") / 90.0).alias("lat_n"), (F.col("lon") / 180.0).alias("lon_n"), "elev_m", "elev_dev_m", "elev_std_m",
        F.when(index < 0, 0).otherwise(F.coalesce(index, F.lit(0))).cast("int").alias("veg_idx"),
    )
