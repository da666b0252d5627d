"""Calendar features and the computed Finnish holiday calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmill.functions.timecols import weekday

# Fixed value: the feature definitions use this shortened pi.
PI = 3.14159


def _easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus (Meeus / Jones / Butcher), as a date."""
    def div(x, n):
        return F.floor(x / n)

    golden = year % 19
    century, rest = div(year, 100), year % 100
    epact = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    letter = (32 + 2 * (century % 4) + 2 * div(rest, 4) - epact - rest % 4) % 7
    late = div(golden + 11 * epact + 22 * letter, 451)
    serial = epact + letter - 7 * late + 114
    return F.make_date(year.cast("int"), div(serial, 31).cast("int"), (serial % 31 + 1).cast("int"))


# Holidays with a fixed date, as month * 100 + day; days after Easter Sunday of Good
# Friday, Easter, Easter Monday, Ascension and Whit Sunday.
FIXED_DAYS = [101, 106, 501, 1206, 1224, 1225, 1226]
EASTER_DAYS = [-2, 0, 1, 39, 49]


def is_holiday(date: Column) -> Column:
    """Whether a date of any year is a Finnish public holiday, by today's rules: a fixed date, a day
    counted from Easter, Midsummer Eve (the Friday from 19 June) and Day (the Saturday from 20 June), or
    All Saints' Day (the Saturday from 31 October)."""
    day = F.month(date) * 100 + F.dayofmonth(date)
    return (
        day.isin(FIXED_DAYS)
        | F.date_diff(date, _easter(F.year(date))).isin(EASTER_DAYS)
        | ((weekday(date) == 5) & day.between(619, 625))
        | ((weekday(date) == 6) & (day.between(620, 626) | day.between(1031, 1106)))
    )


def holidays(spark: SparkSession, first_year: int = 2020, last_year: int = 2030) -> DataFrame:
    """The holidays of some years as a table, for reading; the flags need no table."""
    bounds = [F.make_date(F.lit(y), F.lit(m), F.lit(d)) for y, m, d in ((first_year, 1, 1), (last_year, 12, 31))]
    return spark.range(1).select(F.explode(F.sequence(*bounds)).alias("date")).where(is_holiday(F.col("date")))


def add_holiday_features(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Three flags of a row's own date: holiday, eve (a holiday follows) and bridge (a Friday after a
    Thursday holiday or a Monday before a Tuesday holiday).  A null time has no flag set."""
    if time not in df.columns:
        return df
    date = F.to_date(F.col(time))
    flag = lambda condition: F.coalesce(condition, F.lit(False))
    number, before, after = weekday(date), is_holiday(F.date_sub(date, 1)), is_holiday(F.date_add(date, 1))
    return df.withColumns({
        "is_holiday": flag(is_holiday(date)),
        "is_holiday_eve": flag(after),
        "is_bridge_day": flag(((number == 5) & before) | ((number == 1) & after)),
    })


def add_time_features(df: DataFrame, time: str = "timestamp", weekend_from: int = 5) -> DataFrame:
    """Consumption calendar.  Friday counts as weekend unless `weekend_from` says otherwise."""
    t = F.col(time)
    return df.withColumns({
        "hour_of_day": F.hour(t),
        "day_of_week": weekday(t),
        "month": F.month(t),
        "day_of_month": F.dayofmonth(t),
        "is_weekend": weekday(t) >= weekend_from,
    })


def clock_features(time: str, weekend_from: int = 6) -> dict[str, Column]:
    t = F.col(time)
    hour, day = F.hour(t), weekday(t)
    return {
        "hour": hour,
        "minute": F.minute(t),
        "day_of_week": day,
        "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "is_weekend": day >= weekend_from,
        "is_business_hours": (day <= 5) & hour.between(7, 17),
        "is_peak_hours": hour.between(7, 9) | hour.between(17, 19),
        "is_night_hours": (hour == 23) | (hour <= 4),
    }


def cyclic_features() -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month (the clock columns must exist)."""
    out = {}
    for name, source, period in (("hour", "hour", 24), ("day", "day_of_week", 7), ("month", "month", 12)):
        angle = F.lit(2 * PI) * F.col(source) / period
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def add_calendar_features(df: DataFrame, time: str = "time") -> DataFrame:
    """Price calendar: clock columns, cyclic encodings and holiday flags."""
    return add_holiday_features(df.withColumns(clock_features(time)).withColumns(cyclic_features()), time)
