"""Tumbling resample and hourly / daily rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from seriesmill.functions.sketches import COUNT, BUCKET, bucket, packed
from seriesmill.functions.states import merge_states, stats_state
from seriesmill.functions.timecols import floor_time
from seriesmill.schemas import POWER_MEASURES, WEATHER_MEASURES


def align_to_hourly(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column per hour; the time column is `time` or `timestamp`."""
    time = "time" if "time" in df.columns else "timestamp"
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name != time and f.name not in keys
    ]
    hourly = df.groupBy(*keys, floor_time(df, time, "1 hour").alias("timestamp")) if time != "timestamp" else (
        df.withColumn("timestamp", floor_time(df, time, "1 hour")).groupBy(*keys, "timestamp")
    )
    return hourly.agg(*[F.avg(c).alias(c) for c in numeric])


def resample_mean(
    df: DataFrame, columns: Sequence[str], every: str = "1 hour", time: str = "time",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean of each column per bucket; buckets without rows do not appear."""
    return (
        df.withColumn(time, floor_time(df, time, every))
        .groupBy(*keys, time)
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def resample_power(df: DataFrame, every: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    return resample_mean(df, POWER_MEASURES, every, keys=keys)


def resample_prices(df: DataFrame, every: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    return resample_mean(df, ["price_eur_mwh"], every, keys=keys)


def resample_weather(df: DataFrame, every: str = "1 hour", station_id: str | None = None) -> DataFrame:
    """One station (the given one, else the station of the earliest row): means, and the sum
    of precipitation, where a bucket without any value sums to 0."""
    present = [c for c in WEATHER_MEASURES if c in df.columns]
    if station_id is not None:
        rows = df.where(F.col("station_id") == station_id)
    else:
        first = df.agg(F.min_by("station_id", F.struct("time", "station_id")).alias("__station"))
        rows = df.join(F.broadcast(first), df["station_id"] == first["__station"]).drop("__station")
    aggregates = [
        F.coalesce(F.sum(c), F.lit(0.0)).alias(c) if c == "precipitation_mm" else F.avg(c).alias(c)
        for c in present
    ]
    return rows.withColumn("time", floor_time(rows, "time", every)).groupBy("time").agg(*aggregates)


def power_hourly(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stored hourly rollup: statistics state of consumption, extremes, means, sample count."""
    return df.groupBy(*keys, floor_time(df, "time", "1 hour").alias("hour")).agg(
        stats_state(F.col("consumption_mw")).alias("consumption_stats"),
        F.max("consumption_mw").alias("max_consumption_mw"),
        F.min("consumption_mw").alias("min_consumption_mw"),
        F.avg("production_mw").alias("avg_production_mw"),
        F.avg("wind_mw").alias("avg_wind_mw"),
        F.avg("nuclear_mw").alias("avg_nuclear_mw"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def prices_daily_counts(df: DataFrame) -> DataFrame:
    """The mergeable long form of the daily rollup: per day, area and value bucket the number of prices,
    their statistics state and extremes.  Prices that no bucket counts are a row of their own."""
    price = F.col("price_eur_mwh")
    return df.groupBy(floor_time(df, "time", "1 day").alias("day"), "area", bucket(price).alias(BUCKET)).agg(
        F.count(price).alias(COUNT), stats_state(price).alias("price_stats"),
        F.max(price).alias("max_price"), F.min(price).alias("min_price"),
    )


def prices_daily_state(counts: DataFrame) -> DataFrame:
    """Stored daily rollup per area: statistics state, extremes and the packed quantile sketch."""
    return counts.groupBy("day", "area").agg(
        merge_states("price_stats").alias("price_stats"), F.max("max_price").alias("max_price"),
        F.min("min_price").alias("min_price"), packed().alias("price_distribution"),
    )


def prices_daily(df: DataFrame) -> DataFrame:
    return prices_daily_state(prices_daily_counts(df))
