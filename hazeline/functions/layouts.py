"""Names of variables: the canonical order, feature sets, aliases and what can be derived."""

from __future__ import annotations

from collections.abc import Iterable

# The order of the dynamic slots, the named sets, their synonyms, the sets of source profiles, and aliases.
ORDER = (
    "RH2M", "T2M", "PRECIP", "MSLP", "SW_RAD", "U10", "WSPD10", "V10", "WDIR10", "CAPE", "LCC", "T_925", "RH_925", "U_925", "WSPD925",
    "V_925", "DP_1000", "DP_925", "Q_1000", "Q_925", "W_925", "W_1000", "DPD", "INVERSION",
)
SETS = {
    "common_core": (
        "RH2M", "T2M", "MSLP", "U10", "WSPD10", "V10", "WDIR10", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000", "DP_925", "Q_1000", "Q_925", "DPD",
    ),
    "compact_common_core": (
        "T2M", "MSLP", "U10", "WSPD10", "V10", "WDIR10", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000", "DP_925", "Q_1000", "Q_925", "DPD",
    ),
    "q_core_no_rh2m": (
        "T2M", "MSLP", "U10", "WSPD10", "V10", "WDIR10", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000", "DP_925", "Q_1000", "Q_925",
    ),
    "overlap_full": (
        "RH2M", "T2M", "PRECIP", "MSLP", "SW_RAD", "U10", "WSPD10", "V10", "WDIR10", "LCC", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000",
        "DP_925", "Q_1000", "Q_925", "W_925", "W_1000", "DPD",
    ),
}
_PANGU_2021 = (
    "RH2M", "T2M", "MSLP", "U10", "WSPD10", "V10", "WDIR10", "T_925", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000", "DP_925", "Q_1000",
    "Q_925", "DPD", "INVERSION",
)
_PANGU_2025 = (
    "T2M", "MSLP", "U10", "WSPD10", "V10", "WDIR10", "T_925", "RH_925", "U_925", "WSPD925", "V_925", "DP_1000", "DP_925", "Q_1000", "Q_925",
    "INVERSION",
)
PROFILES = {
    "tianji": ORDER, "t2nd_rh2m": ORDER, "era5": ORDER, "era5_2025": ORDER, "ifs": SETS["overlap_full"], "pangu": _PANGU_2021,
    "pangu2021": _PANGU_2021, "pangu2025": _PANGU_2025,
}
SYNONYMS = {
    "common_core": ("common", "core", "pangu_core", "common_overlap"),
    "compact_common_core": ("compact", "compact_common", "compact_core", "compact_common_core_no_rh2m", "compact_no_rh2m", "compact_common_no_rh2m", "compact_core_no_rh2m"),
    "q_core_no_rh2m": ("q_core", "q1000_core", "q1000_core_no_rh2m", "q_core_common", "q_core_no_rh"),
    "overlap_full": ("full", "overlap", "overlap_canonical"),
    "source_full": ("all", "all_available", "source"),
}
ALIASES = {
    "2D": "D2M", "DEWPOINT2M": "D2M", "DEW_POINT_2M": "D2M", "RH925": "RH_925", "R925": "RH_925", "RH1000": "RH_1000", "R1000": "RH_1000",
    "T925": "T_925", "T1000": "T_1000", "U925": "U_925", "V925": "V_925", "Q1000": "Q_1000", "Q925": "Q_925", "W925": "W_925", "W1000": "W_1000",
    "DP1000": "DP_1000", "DP925": "DP_925", "PM10_UGM3": "PM10", "PM10UGM3": "PM10", "PM10_UG_M3": "PM10", "PM25_UGM3": "PM25",
    "PM25UGM3": "PM25", "PM25_UG_M3": "PM25", "PM2P5": "PM25", "PM2_5": "PM25",
}
NAMES = {**{name: name for name in dict.fromkeys(ALIASES.values())}, **ALIASES}
# The groups of variables that are permuted together, and the candidates of the group of shared low-level moisture.
PACKAGES = {
    "native_near_surface_moisture": ("RH2M", "D2M", "DPD", "Q_1000", "DP_1000"),
    "native_low_level_moisture_structure": ("RH_925", "Q_1000", "Q_925", "DP_1000", "DP_925"),
    "native_thermodynamics": ("T2M", "T_925", "INVERSION", "MSLP"),
    "native_wind_ventilation": ("U10", "V10", "WSPD10", "WDIR10", "U_925", "V_925", "WSPD925", "W_925", "W_1000"),
    "native_cloud_precip_radiation": ("PRECIP", "SW_RAD", "CAPE", "LCC"),
    "native_aerosol": ("PM10", "PM25"),
}
SHARED_MOISTURE = ("RH2M", "DPD", "RH_925", "Q_1000", "Q_925", "DP_1000", "DP_925")


def packages(shared: Iterable[str]) -> list[tuple[str, str]]:
    """(package, member) of all groups, given the variables that all sources share."""
    held = list(shared)
    groups = {**PACKAGES, "shared_low_level_moisture": [x for x in SHARED_MOISTURE if x in held], "shared_dynamic_all": held}
    return [(name, member) for name, members in groups.items() for member in members]


#: A slot and each set of fields that gives it.
DERIVED = (
    ("WSPD10", ("U10", "V10")), ("WDIR10", ("U10", "V10")), ("WSPD925", ("U_925", "V_925")), ("RH2M", ("T2M", "D2M")), ("DPD", ("T2M", "D2M")),
    ("DPD", ("T2M", "RH2M")), ("DP_1000", ("Q_1000",)), ("Q_1000", ("T_1000", "RH_1000")), ("DP_1000", ("T_1000", "RH_1000")),
    ("DP_925", ("Q_925",)), ("Q_925", ("T_925", "RH_925")), ("DP_925", ("T_925", "RH_925")), ("INVERSION", ("T_925", "T2M")),
)


def set_name(name: str | None) -> str:
    key = (name or "overlap_full").strip().lower().replace("-", "_")
    return next((k for k, also in SYNONYMS.items() if key == k or key in also), key)


def profile_set(profile: str | None) -> list[str]:
    """The slots of a source profile; all without one. An unknown profile is an error."""
    key = (profile or "").strip().lower().replace("-", "_")
    if key and key not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known are {', '.join(sorted(PROFILES))}")
    return list(PROFILES[key] if key else ORDER)


def feature_set(name: str | None, available: Iterable[str] | None = None, profile: str | None = None) -> list[str]:
    """The ordered columns of a named set; source_full is what is available of its profile's slots."""
    key = set_name(name)
    if key == "source_full":
        slots = profile_set(profile)
        held = set(slots if available is None else available)
        return [x for x in slots if x in held]
    if key not in SETS:
        raise ValueError(f"unknown feature set {name!r}")
    return list(SETS[key])
