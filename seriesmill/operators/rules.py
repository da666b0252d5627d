"""Row rules: split rows into valid and rejected, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Closed range per column (None: no bound on that side).
RANGES: dict[str, tuple[float | None, float | None]] = {
    "consumption_mw": (0, None),
    "production_mw": (0, None),
    "wind_mw": (0, None),
    "nuclear_mw": (0, None),
    "temperature_c": (-50, 50),
    "humidity_percent": (0, 100),
    "wind_speed_ms": (0, 100),
    "wind_direction": (0, 360),
    "pressure_hpa": (800, 1100),
    "precipitation_mm": (0, None),
    "cloud_cover": (0, 8),
    "price_eur_mwh": (-500, 5000),
    "predicted_consumption_mw": (0, None),
    "confidence_lower": (0, None),
    "confidence_upper": (0, None),
}


def rules(columns: list[str]) -> dict[str, Column]:
    """Name of each applicable rule and the condition that breaks it."""
    broken: dict[str, Column] = {}
    for name, (low, high) in RANGES.items():
        if name in columns:
            value = F.col(name)
            if low is not None:
                broken[f"{name} below {low}"] = value < low
            if high is not None:
                broken[f"{name} above {high}"] = value > high
    if {"confidence_lower", "confidence_upper"} <= set(columns):
        broken["confidence_upper below confidence_lower"] = F.col("confidence_upper") < F.col("confidence_lower")
    if {"confidence_lower", "predicted_consumption_mw", "confidence_upper"} <= set(columns):
        broken["prediction outside its interval"] = ~F.col("predicted_consumption_mw").between(
            F.col("confidence_lower"), F.col("confidence_upper")
        )
    if "station_id" in columns:
        broken["station_id empty"] = F.coalesce(F.length("station_id"), F.lit(0)) == 0
    return broken


def with_reasons(df: DataFrame, name: str = "reasons") -> DataFrame:
    reasons = [F.when(condition, F.lit(label)) for label, condition in rules(df.columns).items()]
    return df.withColumn(name, F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"))


def valid_rows(df: DataFrame) -> DataFrame:
    return with_reasons(df, "__reasons").where(F.size("__reasons") == 0).drop("__reasons")


def rejected_rows(df: DataFrame) -> DataFrame:
    return with_reasons(df).where(F.size("reasons") > 0)
