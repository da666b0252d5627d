"""Schemas of the seven tables, their keys and retention, the dataset catalogue and row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_TYPES = {
    "ts": T.TimestampType(),
    "d": T.DoubleType(),
    "s": T.StringType(),
    "i": T.IntegerType(),
}


def _schema(text: str) -> T.StructType:
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


POWER_MEASURES = ["consumption_mw", "production_mw", "wind_mw", "nuclear_mw", "net_import_mw"]
WEATHER_MEASURES = [
    "temperature_c", "wind_speed_ms", "wind_direction", "cloud_cover",
    "humidity_percent", "pressure_hpa", "precipitation_mm",
]

# `!` marks NOT NULL.
TABLES: dict[str, T.StructType] = {
    "power_actuals": _schema(
        "time:ts! consumption_mw:d production_mw:d wind_mw:d nuclear_mw:d net_import_mw:d "
        "source:s ingested_at:ts"
    ),
    "price_actuals": _schema(
        "time:ts! price_eur_mwh:d! area:s price_type:s source:s ingested_at:ts"
    ),
    "weather_observations": _schema(
        "time:ts! station_id:s station_name:s temperature_c:d humidity_percent:d wind_speed_ms:d "
        "wind_direction:d pressure_hpa:d precipitation_mm:d cloud_cover:i data_type:s ingested_at:ts"
    ),
    "weather_forecasts": _schema(
        "forecast_time:ts! station_id:s station_name:s temperature_c:d wind_speed_ms:d "
        "wind_direction:d cloud_cover:d humidity_percent:d pressure_hpa:d precipitation_mm:d "
        "global_radiation_wm2:d forecast_model:s generated_at:ts ingested_at:ts"
    ),
    "power_forecasts": _schema(
        "forecast_time:ts! forecast_type:s value:d unit:s update_frequency:s generated_at:ts "
        "ingested_at:ts"
    ),
    "consumption_predictions": _schema(
        "timestamp:ts! predicted_consumption_mw:d! confidence_lower:d! confidence_upper:d! "
        "model_type:s model_version:s generated_at:ts"
    ),
    "price_predictions": _schema(
        "prediction_time:ts! model_type:s model_version:s predicted_price_eur_mwh:d! "
        "confidence_lower:d confidence_upper:d predicted_consumption_mw:d generated_at:ts "
        "features_hash:s training_end_date:ts ingested_at:ts"
    ),
}

KEYS: dict[str, list[str]] = {
    "power_actuals": ["time"],
    "price_actuals": ["time", "area", "price_type"],
    "weather_observations": ["time", "station_id", "data_type"],
    "weather_forecasts": ["forecast_time", "station_id", "generated_at"],
    "power_forecasts": ["forecast_time", "forecast_type", "generated_at"],
    "consumption_predictions": ["timestamp", "model_type", "generated_at"],
    "price_predictions": ["prediction_time", "model_type", "generated_at"],
}

# Column that decides the storage partition, and how many days of it are kept.
PARTITION_TIME: dict[str, str] = {
    "power_actuals": "time",
    "price_actuals": "time",
    "weather_observations": "time",
    "weather_forecasts": "forecast_time",
    "power_forecasts": "forecast_time",
    "consumption_predictions": "generated_at",
    "price_predictions": "prediction_time",
}
RETENTION_DAYS: dict[str, int] = {
    "power_actuals": 730,
    "price_actuals": 730,
    "weather_observations": 730,
    "weather_forecasts": 90,
    "power_forecasts": 90,
    "consumption_predictions": 365,
    "price_predictions": 365,
}

# Storage names carry the unit, feature names do not.
FEATURE_NAMES: dict[str, str] = {
    "temperature_c": "temperature",
    "humidity_percent": "humidity",
    "wind_speed_ms": "wind_speed",
    "pressure_hpa": "pressure",
}
STORAGE_NAMES: dict[str, str] = {v: k for k, v in FEATURE_NAMES.items()} | {
    "precipitation": "precipitation_mm",
}

# Source dataset id, metric, kind, unit, update frequency.
DATASETS: list[tuple[int, str, str, str, str]] = [
    (124, "consumption", "actual", "MW", "3min"),
    (192, "production", "actual", "MW", "3min"),
    (75, "wind", "actual", "MW", "15min"),
    (188, "nuclear", "actual", "MW", "3min"),
    (194, "net_import", "actual", "MW", "3min"),
    (336, "shortage", "actual", "state", "15min"),
    (106, "price_down_regulation", "price", "EUR/MWh", "15min"),
    (93, "price_imbalance_sale", "price", "EUR/MWh", "15min"),
    (96, "price_imbalance_buy", "price", "EUR/MWh", "15min"),
    (319, "price_imbalance", "price", "EUR/MWh", "15min"),
    (165, "consumption_daily", "forecast", "MW", "daily"),
    (166, "consumption", "forecast", "MW", "15min"),
    (241, "production", "forecast", "MW", "15min"),
    (245, "wind", "forecast", "MW", "15min"),
    (180, "transmission_fi_ee", "transmission", "MW", "3min"),
    (27, "capacity_fi_se3", "transmission", "MW", "1h"),
    (24, "capacity_fi_se1", "transmission", "MW", "1h"),
    (25, "capacity_fi_ee", "transmission", "MW", "1h"),
]


def dataset_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DATASETS,
        "dataset_id int, metric string, kind string, unit string, update_frequency string",
    )
