"""Moist-air, wind, sun and visibility formulas as columns.

Null in, null out: clips keep null, and domains of logarithms and divisors are guarded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients (hPa, degC), gas ratio, zero Celsius, bounds of specific humidity.
MAGNUS_E, MAGNUS_A, MAGNUS_B = 6.112, 17.67, 243.5
EPSILON, KELVIN = 0.622, 273.15
Q_LEAST, Q_MOST = 1e-8, 0.08


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """c within bounds; null stays null (greatest and least would skip it, so the bounds are null with it).

    c stands in no branch, so Spark evaluates it once however clips are nested."""
    bound = lambda b: F.when(c.isNotNull(), b if isinstance(b, Column) else F.lit(b))
    out = c if low is None else F.greatest(c, bound(low))
    return out if high is None else F.least(out, bound(high))


def vapour_pressure(t_c: Column) -> Column:
    """Saturation vapour pressure in hPa."""
    return F.exp(t_c * MAGNUS_A / (t_c + MAGNUS_B)) * MAGNUS_E


def _dew_point_of(log_ratio: Column) -> Column:
    return log_ratio * MAGNUS_B / clip(F.lit(MAGNUS_A) - log_ratio, low=1e-6) + KELVIN


def rh_from_dewpoint(t_k: Column, td_k: Column) -> Column:
    """Relative humidity in % from temperature and dew point in K."""
    saturated = clip(vapour_pressure(t_k - KELVIN), low=1e-6)
    return clip(vapour_pressure(td_k - KELVIN) * 100.0 / saturated, 0.0, 100.0)


def dewpoint_from_rh(t_k: Column, rh: Column) -> Column:
    t = t_k - KELVIN
    return _dew_point_of(F.log(clip(rh / 100.0, 1e-4, 1.0)) + t * MAGNUS_A / (t + MAGNUS_B))


def dewpoint_from_q(q: Column, p_hpa: float) -> Column:
    """Dew point in K from specific humidity in kg/kg at a pressure in hPa."""
    q = clip(q, Q_LEAST, Q_MOST)
    e = q * p_hpa / clip(q * 0.378 + EPSILON, low=1e-8)
    return _dew_point_of(F.log(clip(e, low=1e-6) / MAGNUS_E))


def q_from_t_rh(t_k: Column, rh: Column, p_hpa: float) -> Column:
    e = clip(rh / 100.0, 0.0, 1.0) * vapour_pressure(t_k - KELVIN)
    r = e * EPSILON / clip(F.lit(p_hpa) - e, low=1e-6)
    return clip(r / clip(r + 1.0, low=1e-8), 0.0, Q_MOST)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, in degrees."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def wrap_longitude(lon: Column, signed: bool = False) -> Column:
    around = F.pmod(lon, F.lit(360.0))
    return F.when(around > 180.0, around - 360.0).otherwise(around) if signed else around


def solar_zenith(day_of_year: Column, utc_hour: Column, lat: Column, lon: Column) -> Column:
    """Zenith angle in degrees from the published series for declination and the equation of time (Spencer 1971)."""
    g = (day_of_year - 1 + (utc_hour - 12) / 24.0) * (2 * math.pi / 365.0)
    declination = (
        F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758 + F.sin(g * 2) * 0.000907
        - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    )
    minutes = (
        F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849
    ) * 229.18
    angle = F.radians((utc_hour * 60.0 + minutes + lon * 4.0) / 4.0 - 180.0)
    phi = F.radians(lat)
    cosine = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(angle)
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def cyclical(month: Column, hour: Column) -> dict[str, Column]:
    m, h = month * (2 * math.pi / 12), hour * (2 * math.pi / 24)
    return {"month_sin": F.sin(m), "month_cos": F.cos(m), "hour_sin": F.sin(h), "hour_cos": F.cos(h)}


def month_of(month_sin: Column, month_cos: Column) -> Column:
    """The month that cyclical() encoded."""
    angle = F.atan2(month_sin, month_cos)
    turned = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    month = F.round(turned * 6 / math.pi).cast("int")
    return F.when(month == 0, 12).otherwise(month)


def visibility_class(vis_m: Column) -> Column:
    """0 fog under 500 m, 1 mist under 1000 m, 2 clear; null stays null."""
    return F.when(vis_m < 500, 0).when(vis_m < 1000, 1).when(vis_m.isNotNull(), 2)


def soft_label(vis_m: Column) -> Column:
    """Probabilities of fog, mist, clear that blend linearly over 400-600 m and 800-1200 m."""
    fog = clip((F.lit(600.0) - vis_m) / 200.0, 0.0, 1.0)
    clear = clip((vis_m - 800.0) / 400.0, 0.0, 1.0)
    return F.when(vis_m.isNotNull(), F.array(fog, F.lit(1.0) - fog - clear, clear))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.exp(-c) + 1.0)
