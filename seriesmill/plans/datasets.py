"""Feature sets and training / prediction datasets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmill.functions.calendar import add_calendar_features, add_holiday_features, add_time_features
from seriesmill.functions.supply import add_supply_features
from seriesmill.functions.timecols import bucket_count, moment
from seriesmill.functions.weather import add_weather_features, add_weather_interactions
from seriesmill.operators.asof import asof_backward
from seriesmill.operators.history import add_price_history, add_price_history_to_future, add_target_history
from seriesmill.operators.joins import FORECAST_TYPES, pivot_power_forecasts
from seriesmill.operators.latest import latest_per_key
from seriesmill.operators.resample import align_to_hourly, resample_power, resample_prices, resample_weather
from seriesmill.schemas import FEATURE_NAMES, POWER_MEASURES, WEATHER_MEASURES
from seriesmill.sources.scans import DATE, time_range

# Names that never are features, and columns that must be known in training.
NOT_FEATURES = [
    "time", "forecast_time", "prediction_time", "price_eur_mwh", "station_id", "station_name",
    "generated_at", "created_at",
]
CRITICAL = ["temperature", "humidity", "wind_speed", "pressure"]
NULL_SHARE = 0.2


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def null_count(columns: Sequence[str]) -> Column:
    """Number of NULLs in a row (NaN is a value)."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def drop_sparse_rows(df: DataFrame, share: float = NULL_SHARE) -> DataFrame:
    return df.where(null_count(df.columns) <= int(len(df.columns) * share))


def require_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in present])) if present else df


def feature_names(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and c not in exclude]


def with_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` and those whose name begins with one of the prefixes, in their order."""
    return df.select(*(c for c in df.columns if c in keep or c.startswith(tuple(prefixes))))


def consumption_features(
    df: DataFrame, target: str = "consumption_mw", *, keys: Sequence[str] = (), drop_nulls: bool = True,
    max_rows: int | None = None, at_most: int | None = None,
) -> DataFrame:
    framed = add_target_history(df, target, keys=keys, max_rows=max_rows, at_most=at_most)
    full = add_weather_interactions(add_holiday_features(add_time_features(framed), "timestamp"))
    return require_values(full, [target, *CRITICAL]) if drop_nulls else full


def training_features(
    df: DataFrame, time: str = "time", price: str = "price_eur_mwh", *, keys: Sequence[str] = (),
    max_rows: int | None = None, at_most: int | None = None,
) -> DataFrame:
    framed = add_price_history(df, price, time=time, keys=keys, max_rows=max_rows, at_most=at_most)
    return add_supply_features(add_weather_features(add_calendar_features(framed, time)), "actual")


def prediction_features(
    df: DataFrame, history: DataFrame, time: str = "forecast_time", *, keys: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    framed = add_price_history_to_future(df, history, time=time, keys=keys, max_rows=max_rows)
    return add_supply_features(
        add_weather_features(add_calendar_features(framed, time), "forecast"), "forecast"
    )


def hourly_inputs(
    power: DataFrame, prices: DataFrame, weather: DataFrame | None, every: str = "1 hour"
) -> DataFrame:
    """Resampled power with resampled prices and weather on the same time."""
    joined = resample_power(power, every).join(resample_prices(prices, every), "time", "left")
    if weather is None:
        return joined
    present = [c for c in WEATHER_MEASURES if c in weather.columns]
    return joined.join(resample_weather(weather, every).select("time", *present), "time", "left")


def training_dataset(
    power: DataFrame, prices: DataFrame, weather: DataFrame | None, start: str, end: str, *,
    every: str = "1 hour", area: str = "FI", price_type: str | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Rows with a known price and at most 20 % NULL columns; raises without power or prices."""
    power = time_range(power, "time", start, end)
    prices = time_range(prices, "time", start, end).where(F.col("area") == area)
    if price_type is not None:
        prices = prices.where(F.col("price_type") == price_type)
    for name, df in (("consumption", power), ("price", prices)):
        if df.isEmpty():
            raise ValueError(f"No {name} data found for training period")
    inputs = hourly_inputs(power, prices, None if weather is None else time_range(weather, "time", start, end), every)
    full = training_features(inputs, max_rows=max_rows, at_most=bucket_count(start, end, every))
    return drop_sparse_rows(full.where(F.col("price_eur_mwh").isNotNull()))


def prediction_dataset(
    weather_forecasts: DataFrame, power_forecasts: DataFrame, prices: DataFrame, start: str, end: str, *,
    lookback_hours: int = 720, area: str = "FI", station_id: str | None = None,
    types: Sequence[str] = FORECAST_TYPES, literal_history: bool = False, max_rows: int | None = None,
) -> DataFrame:
    """Newest forecasts of the range with price history features.

    History ends before `start`; `literal_history` also takes a price at `start` itself.
    """
    def newest(df, keys):
        inside = time_range(df, "forecast_time", start, end)
        if DATE in inside.columns:
            inside = inside.drop(DATE)
        return latest_per_key(inside, ["forecast_time", *keys], ["generated_at"])

    weather = weather_forecasts
    if station_id is not None:
        weather = weather.where(F.col("station_id") == station_id)
    weather = rename_present(newest(weather, ["station_id"]), FEATURE_NAMES)
    power = newest(power_forecasts.where(F.col("forecast_type").isin(*types)), ["forecast_type"])
    joined = weather.join(pivot_power_forecasts(power, types), "forecast_time", "left")
    since = (datetime.fromisoformat(start) - timedelta(hours=lookback_hours)).isoformat(sep=" ")
    history = time_range(prices, "time", since, start).where(F.col("area") == area)
    if not literal_history:
        history = history.where(F.col("time") < moment(prices, "time", start))
    return prediction_features(joined, history, max_rows=max_rows)


# Day folders that a backward read tries, twice as many each time; after these all older ones.
FARTHEST_DAYS = 4096


def newest_before(df: DataFrame, time: str, columns: Sequence[str], start: str) -> DataFrame:
    """The newest row before `start` (of several the largest in column order), or no row.

    A stored table is read backwards by its day folders: the last day, the two before it, the four
    before those, until one holds a row.
    """
    row = F.struct(time, *columns)
    day = date.fromisoformat(start[:10])
    parts = [df]
    if DATE in df.columns:
        folder, upper, span, parts = F.col(DATE), day, 1, []
        while span <= FARTHEST_DAYS:
            lower = day - timedelta(days=span)
            parts.append(df.where((folder >= F.lit(lower)) & (folder <= F.lit(upper))))
            upper, span = lower - timedelta(days=1), 2 * span
        parts.append(df.where(folder <= F.lit(upper)))
    for part in parts:
        found = part.where(F.col(time) < moment(df, time, start)).agg(F.max(row).alias("row")).first()["row"]
        if found is not None:
            return df.sparkSession.createDataFrame([found], df.select(time, *columns).schema)
    return df.select(time, *columns).limit(0)


def known_at_start(df: DataFrame, time: str, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """What an as-of join needs of its right side for left rows between start and end: the rows of the
    range and the one that holds at its start."""
    inside = time_range(df, time, start, end).select(time, *columns)
    return inside.unionByName(newest_before(df, time, columns, start))


def joined_training_data(
    power: DataFrame, weather: DataFrame, start: str, end: str, *, max_age: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Power actuals of the range, each with the newest weather row at or before it."""
    columns = [c for c in WEATHER_MEASURES if c in weather.columns]
    joined = asof_backward(
        time_range(power, "time", start, end).select("time", *POWER_MEASURES),
        known_at_start(weather, "time", columns, start, end),
        columns=columns, max_age=max_age, max_rows=max_rows,
    )
    doubles = [F.col(c).cast("double").alias(c) for c in joined.columns if c != "time"]
    return rename_present(joined.select("time", *doubles), FEATURE_NAMES)


def consumption_training_table(
    power: DataFrame, weather: DataFrame, start: str, end: str, max_rows: int | None = None
) -> DataFrame:
    return consumption_features(
        align_to_hourly(joined_training_data(power, weather, start, end, max_rows=max_rows)),
        max_rows=max_rows, at_most=bucket_count(start, end, "1 hour"),
    )


# Intervals in which the cut of a chronological split is looked for, one inside the other, and the
# rows that are ranked by one task once the interval of the cut holds no more.
GRAINS = ("month", "day", "hour", "minute", "second", "millisecond")
RANKED_ROWS = 100_000


def chronological_split(
    df: DataFrame, test_size: float = 0.2, time: str = "time", *, tie_break: Sequence[str] = (), ranked_rows: int = RANKED_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """First int(n * (1 - test_size)) rows in time order, and the rest.

    Rows are counted per month, then per day of the month that holds the cut, and so on until few
    rows are left around the cut.  Only these are ranked; all other rows are compared with their bounds.
    Rows without a time come first.  Rows of equal time are ordered by `tie_break`, then by their
    content, so both parts agree.
    """
    content = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    cells = [F.date_trunc(grain, F.col(time)) for grain in GRAINS]
    if not tie_break:  # rows of one time, or without any, are divided by their content
        cells += [F.shiftright(content, bits) for bits in (48, 32, 16)]

    quota, before = None, 0
    ahead, inside = F.lit(False), F.lit(True)
    for cell in cells:
        # Months of the whole table, then days of a month, and so on: the rows to the driver are few.
        found = df.where(inside).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = sorted(((r["cell"], r["n"]) for r in found), key=lambda c: (c[0] is not None, c[0]))
        if quota is None:
            quota = math.floor(sum(n for _, n in counts) * (1 - test_size))
        edge, held = None, 0
        for edge, held in counts:
            if before + held > quota:
                break
            before += held
        else:  # the cut lies behind the last row
            return df, df.limit(0)
        at = F.lit(edge).cast(df.select(cell.alias("c")).schema["c"].dataType)
        ahead = ahead | (inside & ~cell.eqNullSafe(at) & F.coalesce(cell < at, cell.isNull()))
        inside = inside & cell.eqNullSafe(at)
        if held <= ranked_rows:
            break
    behind, take = ~inside & ~ahead, quota - before
    if take == 0:
        return df.where(ahead), df.where(~ahead)
    order = Window.partitionBy(F.col("__edge")).orderBy(time, *tie_break, "__content")
    ranked = df.where(inside).withColumn("__edge", F.lit(1)).withColumn("__content", content).withColumn(
        "__rank", F.row_number().over(order)).drop("__edge", "__content")
    head = ranked.where(F.col("__rank") <= take).drop("__rank")
    tail = ranked.where(F.col("__rank") > take).drop("__rank")
    return df.where(ahead).unionByName(head), df.where(behind).unionByName(tail)
