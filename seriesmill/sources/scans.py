"""Range scans.  Bounds are literals of the column's own type, so they reach the Parquet reader."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.functions.timecols import moment
from seriesmill.operators.latest import latest_per_key
from seriesmill.schemas import FEATURE_NAMES, POWER_MEASURES, WEATHER_MEASURES
from seriesmill.session import folder_values

DATE = "date"


def time_range(df: DataFrame, time: str, start: str, end: str | None = None) -> DataFrame:
    """Rows with start <= time <= end (no end: all later rows).

    A stored table is partitioned by the date of its time column; the same bounds are put on
    that column, so that whole folders are skipped.
    """
    at = F.col(time)
    out = df.where(at >= moment(df, time, start))
    if end is not None:
        out = out.where(at <= moment(df, time, end))
    if DATE in df.columns:
        out = out.where(F.col(DATE) >= F.to_date(F.lit(start)))
        if end is not None:
            out = out.where(F.col(DATE) <= F.to_date(F.lit(end)))
    return out


def power_actuals(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    return time_range(df, "time", start, end).select("time", *POWER_MEASURES)


def prices(
    df: DataFrame, start: str, end: str | None = None, area: str = "FI", price_type: str | None = None
) -> DataFrame:
    out = time_range(df, "time", start, end).where(F.col("area") == area)
    if price_type is not None:
        out = out.where(F.col("price_type") == price_type)
    return out.select("time", "price_eur_mwh", "area", "price_type")


def weather(df: DataFrame, start: str, end: str | None = None, station_id: str | None = None) -> DataFrame:
    """Weather rows under feature names (without units)."""
    out = time_range(df, "time", start, end)
    if station_id is not None:
        out = out.where(F.col("station_id") == station_id)
    present = [c for c in WEATHER_MEASURES if c in df.columns]
    return out.select(
        "time", "station_id", *[F.col(c).alias(FEATURE_NAMES.get(c, c)) for c in present]
    )


def weather_forecasts(
    df: DataFrame, start: str, end: str | None = None, station_id: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """Newest forecast per time and station."""
    out = time_range(df, "forecast_time", start, end)
    if station_id is not None:
        out = out.where(F.col("station_id") == station_id)
    if model is not None:
        out = out.where(F.col("forecast_model") == model)
    return latest_per_key(out, ["forecast_time", "station_id"], ["generated_at"])


def power_forecasts(
    df: DataFrame, start: str, end: str | None = None, types: Sequence[str] | None = None
) -> DataFrame:
    """Newest forecast per time and type."""
    out = time_range(df, "forecast_time", start, end)
    if types:
        out = out.where(F.col("forecast_type").isin(*types))
    return latest_per_key(out, ["forecast_time", "forecast_type"], ["generated_at"])


def last_hours(df: DataFrame, time: str, hours: int, as_of: str) -> DataFrame:
    since = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    return time_range(df, time, since.isoformat(sep=" "), as_of)


def newest_snapshot(spark: SparkSession, root: str, column: str = "snapshot_date") -> DataFrame:
    """The newest dated snapshot; its date is found from the folder names, not from the rows."""
    newest = max(folder_values(spark, root, column))
    return spark.read.parquet(root).where(F.col(column) == F.lit(newest)).drop(column)


def sql_scan(
    spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None,
    args: dict | None = None, types: dict[str, str] | None = None,
) -> DataFrame:
    """A SQL text with `:name` parameters and `{table}` inputs, and casts for chosen columns."""
    out = spark.sql(query, args=args or {}, **(tables or {}))
    types = types or {}
    return out.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in out.columns])
