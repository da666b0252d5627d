"""Ingest jobs: decoded payloads or frames in, stored tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.functions.timecols import moment, shift_time
from seriesmill.operators.joins import merge_and_fill
from seriesmill.schemas import dataset_catalogue
from seriesmill.session import cut
from seriesmill.sinks import tables
from seriesmill.sources.payloads import decode_points, decode_weather, weather_to_frame

PRICE_BUFFER_HOURS = 168


def in_window(df: DataFrame, time: str, start: str, end: str, buffer_hours: int = 0) -> DataFrame:
    low = shift_time(moment(df, time, start), -buffer_hours)
    return df.where((F.col(time) >= low) & (F.col(time) <= moment(df, time, end)))


def with_catalogue(points: DataFrame, kind: str) -> DataFrame:
    """Adds metric, unit and frequency of the dataset; unknown datasets are dropped.  The
    catalogue is a fixed list."""
    catalogue = dataset_catalogue(points.sparkSession).where(F.col("kind") == kind)
    return points.join(F.broadcast(catalogue), "dataset_id")


def ingest_actuals(points: DataFrame, path: str, start: str, end: str, max_rows: int | None = None) -> DataFrame:
    """Points (dataset_id, timestamp, value) of the five power series: merge, fill, upsert."""
    inside = in_window(with_catalogue(points, "actual"), "timestamp", start, end)
    # Stored once: the upsert looks at its batch more than once.
    merged = cut(merge_and_fill(inside, max_rows=max_rows))
    tables.store_power(merged, path)
    return merged


def ingest_prices(
    points: DataFrame, path: str, start: str, end: str, buffer_hours: int = PRICE_BUFFER_HOURS
) -> tuple[int, int]:
    """Prices from `buffer_hours` before the start, so that the lags of the first rows are known."""
    inside = in_window(points, "timestamp", start, end, buffer_hours)
    return tables.store_prices(inside.select("timestamp", F.col("value").alias("price_eur_mwh")), path)


def ingest_forecasts(
    points: DataFrame, path: str, start: str, end: str, run: str,
    types: Sequence[str] = ("consumption", "production", "wind"),
) -> None:
    """Forecast points of the chosen types; all rows of the call share one run time."""
    inside = in_window(with_catalogue(points, "forecast"), "timestamp", start, end)
    typed = inside.where(F.col("metric").isin(*types)).withColumnRenamed("metric", "forecast_type")
    tables.store_power_forecast(typed, path, generated_at=run)


def ingest_weather(
    payloads: DataFrame, path: str, *, order: str | None = None, start: str | None = None, end: str | None = None
) -> None:
    """Observation payloads (station_id, station_name, payload), of a window if one is given."""
    rows = decode_weather(payloads, "payload", "station_id", "station_name", order=order)
    if start is not None:
        rows = in_window(rows, "timestamp", start, end)
    tables.store_weather(weather_to_frame(rows), path)


def ingest_weather_forecast(payloads: DataFrame, path: str, *, model: str, run: str) -> None:
    """Forecast payloads; rows without a temperature are dropped, precipitation and wind
    direction are not kept."""
    rows = decode_weather(payloads, "payload", "station_id", "station_name", forecast=True)
    kept = weather_to_frame(rows).where(F.col("temperature_c").isNotNull())
    tables.store_weather_forecast(
        kept.drop("precipitation_mm", "wind_direction"), path, station_id=None, model=model, generated_at=run
    )


def concatenate_chunks(chunks: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Points of many request windows in series and time order."""
    return decode_points(chunks, "payload").orderBy(*keys, "start_time")


# Windows of the scheduled jobs, in hours.
SCHEDULED_HOURS = {"power_actuals": 720, "weather_observations": 720, "power_short": 6, "price_actuals": 72}
# The short pull between two full ones.
SHORT_HOURS = {
    "power_actuals": SCHEDULED_HOURS["power_short"], "weather_observations": SCHEDULED_HOURS["power_short"],
    "price_actuals": SCHEDULED_HOURS["price_actuals"],
}
BACKFILL_HOURS = 720


def backfill(
    spark: SparkSession, root: str, as_of: str, hours: int | Mapping[str, int] = BACKFILL_HOURS, *,
    power: DataFrame | None = None, prices: DataFrame | None = None, forecasts: DataFrame | None = None,
    weather_payloads: DataFrame | None = None, weather_order: str | None = None,
) -> DataFrame:
    """Runs the jobs whose input is given over the last `hours` hours (of all targets, or by
    target) and reports the stored rows per target (counted from file footers)."""
    end, done = as_of, {}

    def start(table: str) -> str:
        span = hours if isinstance(hours, int) else hours.get(table, BACKFILL_HOURS)
        return (datetime.fromisoformat(as_of) - timedelta(hours=span)).isoformat(sep=" ")

    if power is not None:
        done["power_actuals"] = lambda p: ingest_actuals(power, p, start("power_actuals"), end)
    if prices is not None:
        done["price_actuals"] = lambda p: ingest_prices(prices, p, start("price_actuals"), end)
    if forecasts is not None:
        done["power_forecasts"] = lambda p: ingest_forecasts(forecasts, p, start("power_forecasts"), end, as_of)
    if weather_payloads is not None:
        done["weather_observations"] = lambda p: ingest_weather(
            weather_payloads, p, order=weather_order, start=start("weather_observations"), end=end)
    counts = []
    for table, job in done.items():
        path = f"{root.rstrip('/')}/{table}"
        job(path)
        counts.append((table, tables.read_table(spark, path).count()))
    return spark.createDataFrame(counts, "table_name string, row_count long")
