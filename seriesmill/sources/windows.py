"""Splitting of a request range into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_WEATHER_HOURS = 168


def half_open_windows(df: DataFrame, start: str, end: str, hours: int) -> DataFrame:
    """Adds (window_start, window_end): [start, end) in steps of `hours`, the last one cut."""
    step = F.make_dt_interval(hours=F.lit(hours))
    starts = F.when(
        F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), step)
    )
    return df.withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.least(F.col("window_start") + step, F.col(end))
    )


def weather_windows(df: DataFrame, start: str, end: str, hours: int = MAX_WEATHER_HOURS) -> DataFrame:
    """The same for a source whose windows include both ends: the next one starts a second later."""
    length = F.make_dt_interval(hours=F.lit(hours))
    step = F.make_dt_interval(hours=F.lit(hours), secs=F.lit(1.0))
    starts = F.when(
        F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), step)
    )
    return df.withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.least(F.col("window_start") + length, F.col(end))
    )
