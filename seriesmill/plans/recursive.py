"""Recursive multi-step forecast: every prediction becomes history of the next step.

One row per series holds the last values as an array (newest first), the held-constant
columns and the weather of the coming hours.  A step is then a narrow projection for all
series in parallel: no shuffle and no look at the history table.  Only the horizon is a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmill.functions.calendar import add_holiday_features, add_time_features
from seriesmill.functions.weather import add_weather_interactions
from seriesmill.operators.history import TARGET_LAGS, WINDOWS
from seriesmill.operators.latest import last_known
from seriesmill.plans.models import Z_95
from seriesmill.session import cut

HELD = ("production_mw", "wind_mw", "nuclear_mw", "net_import_mw")


def newest_values(
    history: DataFrame, target: str, size: int, *, time: str = "timestamp", keys: Sequence[str] = ()
) -> DataFrame:
    """The last `size` values per series, newest first.  The rank filter also works before the
    shuffle, so a long series sends at most `size` rows per task."""
    if not keys:
        newest = history.orderBy(F.col(time).desc()).limit(size)
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))
        newest = history.withColumn("__rank", rank).where(F.col("__rank") <= size)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(target).alias("v"))), asc=False)
    return newest.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("__past"))


def history_features(target: str, lags: Sequence[int], windows: Sequence[int]) -> dict[str, Column]:
    """Lags and rolling statistics of a row whose own value is not known: a window of n rows
    has the n - 1 values before it."""
    past = F.col("__past")
    out = {f"{target}_lag_{n}h": F.try_element_at(past, F.lit(n)) for n in lags}
    for n in windows:
        values = F.filter(F.slice(past, 1, n - 1), lambda v: v.isNotNull())
        count = F.size(values)
        zero = F.lit(0.0)
        mean = F.aggregate(values, zero, lambda a, v: a + v) / F.nullif(count, F.lit(0))
        squares = F.aggregate(values, zero, lambda a, v: a + v * v)
        spread = (squares - mean * mean * count) / F.nullif(count - 1, F.lit(0))
        out[f"{target}_rolling_mean_{n}h"] = mean
        out[f"{target}_rolling_std_{n}h"] = F.sqrt(F.greatest(spread, zero))
        out[f"{target}_rolling_min_{n}h"] = F.array_min(values)
        out[f"{target}_rolling_max_{n}h"] = F.array_max(values)
    # `greatest` skips NULL, so a spread of fewer than two values is set back to NULL.
    for n in windows:
        values = F.filter(F.slice(past, 1, n - 1), lambda v: v.isNotNull())
        name = f"{target}_rolling_std_{n}h"
        out[name] = F.when(F.size(values) > 1, out[name])
    return out


def recursive_forecast(
    history: DataFrame,
    weather: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    target: str = "consumption_mw",
    keys: Sequence[str] = (),
    horizon: int = 24,
    rmse: float | None = None,
    lags: Sequence[int] = TARGET_LAGS,
    windows: Sequence[int] = WINDOWS,
    cut_every: int = 6,
) -> DataFrame:
    """`history` and `weather` are hourly with a `timestamp`; the hours of `weather` are forecast
    in order, at most `horizon` per series.  Weather without the keys holds for every series.  `score` adds a `prediction` column.  `rmse` is the
    half width / 1.96 of the interval (none: no width, as for a single scored row)."""
    size = max([*lags, *windows])
    held = [c for c in HELD if c in history.columns]
    # Everything that does not depend on earlier predictions is computed once, before the loop.
    weather = add_weather_interactions(add_holiday_features(add_time_features(weather), "timestamp"))
    conditions = [c for c in weather.columns if c not in keys and c != "timestamp"]
    own_weather = bool(keys) and set(keys) <= set(weather.columns)
    if own_weather:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp"))
        coming = weather.withColumn("__rank", rank).where(F.col("__rank") <= horizon)
    else:
        coming = weather.orderBy("timestamp").limit(horizon)
    hours = coming.groupBy(*(keys if own_weather else [])).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", *conditions))).alias("__hours")
    )
    past = newest_values(history, target, size, keys=keys)
    if held:
        known = last_known(history, "timestamp", held, keys)
        past = past.join(known, list(keys)) if keys else past.crossJoin(F.broadcast(known))
    # Common weather is one row of at most `horizon` hours.
    state = past.join(hours, list(keys)) if own_weather else past.crossJoin(F.broadcast(hours))
    state = cut(state.withColumn("__done", F.expr(
        "CAST(array() AS array<struct<timestamp:%s,prediction:double>>)" % weather.schema["timestamp"].dataType.simpleString()
    )))
    frame = [*keys, "__past", "__hours", "__done", *held]
    for step in range(1, horizon + 1):
        hour = F.try_element_at(F.col("__hours"), F.lit(step))
        row = state.withColumns({
            "timestamp": hour["timestamp"], **{c: hour[c] for c in conditions},
            **history_features(target, lags, windows),
        })
        scored = score(row)
        due = F.col("timestamp").isNotNull()
        fresh = F.struct(F.col("timestamp"), F.col("prediction"))
        state = scored.select(
            *keys,
            F.when(due, F.slice(F.array_prepend("__past", F.col("prediction")), 1, size)).otherwise(F.col("__past")).alias("__past"),
            "__hours",
            F.when(due, F.array_append("__done", fresh)).otherwise(F.col("__done")).alias("__done"),
            *held,
        ).select(*frame)
        if step % cut_every == 0 and step < horizon:
            state = cut(state)
    width = F.lit(0.0 if rmse is None else Z_95 * rmse)
    return state.select(*keys, F.explode("__done").alias("__d")).select(
        *keys,
        F.col("__d.timestamp").alias("timestamp"),
        F.col("__d.prediction").alias("predicted_consumption_mw"),
        (F.col("__d.prediction") - width).alias("confidence_lower"),
        (F.col("__d.prediction") + width).alias("confidence_upper"),
    )
