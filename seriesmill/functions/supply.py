"""Supply and demand features.  A feature appears only when its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Input names in the two modes, and thresholds.
INPUTS = {
    "actual": {
        "consumption": "consumption_mw", "production": "production_mw", "wind": "wind_mw",
        "nuclear": "nuclear_mw", "import": "net_import_mw",
    },
    "forecast": {
        "consumption": "consumption_forecast_mw", "production": "production_forecast_mw",
        "wind": "wind_forecast_mw", "nuclear": "nuclear_forecast_mw", "import": "import_forecast_mw",
    },
}
TIGHT_MARGIN, HIGH_WIND_SHARE = 0.05, 0.3


def _share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1); NULL stays NULL (`greatest` would skip it)."""
    return part / F.when(whole < 1, 1.0).otherwise(whole)


def supply_features(columns: list[str], mode: str = "actual") -> dict[str, Column]:
    names = INPUTS[mode]
    have = {k for k, name in names.items() if name in columns}
    c, p, w, n, i = (F.col(names[k]) for k in ("consumption", "production", "wind", "nuclear", "import"))
    new: dict[str, Column] = {}
    if {"consumption", "production"} <= have:
        new |= {
            "net_supply_mw": p - c,
            "supply_demand_ratio": _share(p, c),
            "is_shortage": p < c,
            "is_tight_margin": _share(p - c, c) < TIGHT_MARGIN,
        }
    if {"wind", "production"} <= have:
        new |= {"wind_penetration": _share(w, p), "is_high_wind_penetration": w > p * HIGH_WIND_SHARE}
    if {"nuclear", "production"} <= have:
        new["nuclear_share"] = _share(n, p)
    if {"import", "consumption"} <= have:
        new |= {"import_dependency": _share(i, c), "is_importing": i > 0, "is_exporting": i < 0}
    return new


def add_supply_features(df: DataFrame, mode: str = "actual") -> DataFrame:
    new = supply_features(df.columns, mode)
    return df.withColumns(new) if new else df
