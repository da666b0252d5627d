"""Time arithmetic that keeps the type (TIMESTAMP or TIMESTAMP_NTZ) of its input."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

_CALENDAR_UNITS = {
    "1 minute": "minute",
    "1 hour": "hour",
    "1 day": "day",
    "1 week": "week",
    "1 month": "month",
}
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(duration: str) -> int:
    """Seconds of a duration such as `15 minutes` or `1 hour`."""
    number, unit = duration.split()
    return int(number) * _UNIT_SECONDS[unit.rstrip("s")]


def bucket_count(start: str, end: str, every: str) -> int:
    """Largest number of buckets that a closed time range can touch."""
    span = datetime.fromisoformat(end) - datetime.fromisoformat(start)
    return int(span.total_seconds() // seconds(every)) + 2


def time_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def floor_time(df: DataFrame, name: str, every: str) -> Column:
    """Start of the tumbling bucket of width `every` that holds the time."""
    kind = time_type(df, name)
    if every in _CALENDAR_UNITS:
        return F.date_trunc(_CALENDAR_UNITS[every], F.col(name)).cast(kind)
    width = seconds(every)
    epoch = F.unix_seconds(F.col(name).cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(width))).cast(kind)


def shift_time(time: Column, hours: float) -> Column:
    """Time moved by a fixed number of hours."""
    return time + F.make_dt_interval(secs=F.lit(float(hours) * 3600.0))


def moment(df: DataFrame, name: str, value: str | datetime) -> Column:
    """Literal bound of the same type as the time column, so that it can be pushed down."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast(time_type(df, name))


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def weekday(time: Column) -> Column:
    """ISO weekday, 1 = Monday to 7 = Sunday."""
    return F.weekday(time) + 1
