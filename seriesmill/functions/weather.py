"""Weather-derived features.  A feature appears only when its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds of the feature definitions.
HEATING_BASE, COOLING_BASE = 18, 22
EXTREME_COLD, MILD_COLD_UPTO, FREEZING = -10, 10, 0
CUT_IN_WIND, HIGH_WIND = 3, 12
LOW_PRESSURE, HIGH_PRESSURE = 1000, 1020
OVERCAST_OKTAS, HEAVY_PRECIPITATION = 6, 5


def heating_degrees(t: Column) -> Column:
    """Degrees below the heating base; 0 for a NULL temperature."""
    return F.when(t < HEATING_BASE, HEATING_BASE - t).otherwise(0)


def cooling_degrees(t: Column) -> Column:
    return F.when(t > COOLING_BASE, t - COOLING_BASE).otherwise(0)


def wind_chill(t: Column, wind_ms: Column) -> Column:
    """Wind chill index; the wind speed is converted to km/h."""
    factor = F.pow(wind_ms * 3.6, F.lit(0.16))
    return 13.12 + 0.6215 * t - 11.37 * factor + 0.3965 * t * factor


def add_weather_interactions(df: DataFrame) -> DataFrame:
    new = {}
    if "temperature" in df.columns:
        t = F.col("temperature")
        new["heating_degree_days"] = heating_degrees(t)
        new["cooling_degree_days"] = cooling_degrees(t)
        new["temperature_squared"] = t * t
        if "wind_speed" in df.columns:
            new["wind_chill"] = wind_chill(t, F.col("wind_speed"))
    return df.withColumns(new) if new else df


def weather_features(columns: list[str], mode: str = "observation") -> dict[str, Column]:
    """Features from storage names (`observation`) or feature names (`forecast`)."""
    temperature, wind = (
        ("temperature_c", "wind_speed_ms") if mode == "observation" else ("temperature", "wind_speed")
    )
    pressure = "pressure_hpa" if "pressure_hpa" in columns else "pressure"
    t, w = F.col(temperature), F.col(wind)
    new: dict[str, Column] = {}
    if temperature in columns:
        new |= {
            "heating_degree_days": heating_degrees(t),
            "is_extreme_cold": t < EXTREME_COLD,
            "is_mild_cold": (t >= FREEZING) & (t < MILD_COLD_UPTO),
            "is_freezing": t < FREEZING,
            "temperature_squared": t * t,
        }
    if wind in columns:
        new |= {
            "is_no_wind": w < CUT_IN_WIND,
            "is_good_wind": (w >= CUT_IN_WIND) & (w < HIGH_WIND),
            "is_high_wind": w >= HIGH_WIND,
            "wind_speed_squared": w * w,
            "wind_speed_cubed": w * w * w,
        }
    if pressure in columns:
        new |= {
            "is_low_pressure": F.col(pressure) < LOW_PRESSURE,
            "is_high_pressure": F.col(pressure) > HIGH_PRESSURE,
        }
    if "cloud_cover" in columns:
        new["is_overcast"] = F.col("cloud_cover") > OVERCAST_OKTAS
    if "precipitation_mm" in columns:
        rain = F.col("precipitation_mm")
        new |= {"is_precipitation": rain > 0, "is_heavy_precipitation": rain > HEAVY_PRECIPITATION}
    if temperature in columns and wind in columns:
        new |= {"wind_chill": wind_chill(t, w), "temp_wind_interaction": t * w}
    return new


def add_weather_features(df: DataFrame, mode: str = "observation") -> DataFrame:
    new = weather_features(df.columns, mode)
    return df.withColumns(new) if new else df
