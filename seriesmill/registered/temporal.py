"""Registered queries: merging, alignment, as-of joins, fills, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import joins, latest, resample
from seriesmill.operators.asof import asof_backward, asof_nearest
from seriesmill.plans.datasets import chronological_split, joined_training_data
from seriesmill.registered.base import END, START, query
from seriesmill.schemas import POWER_MEASURES, WEATHER_MEASURES

# A low limit makes the split form run on small data too.
SPLIT_ROWS = 700


def _merged(minute: str) -> str:
    metrics = ["consumption", "production", "wind", "nuclear", "net_import"]
    parts = [
        f"(SELECT CAST(date_trunc('minute', time) AS TIMESTAMP) AS timestamp, max(value) AS {m}_mw FROM points "
        f"WHERE metric = '{m}' GROUP BY 1) {m}"
        for m in metrics
    ]
    joined = parts[0] + "".join(f" FULL JOIN {p} USING (timestamp)" for p in parts[1:])
    return f"SELECT timestamp, {', '.join(f'{m}_mw' for m in metrics)} FROM {joined}"


MERGE_SQL = _merged("minute")
METRICS = ["consumption", "production", "wind", "nuclear", "net_import"]


def _minute_points(t):
    return t.points.select(
        F.date_trunc("minute", "time").cast("timestamp_ntz").alias("timestamp"), "metric", "value", "user_id"
    )


@query("j1_merge_series", MERGE_SQL)
def _(t):
    return joins.merge_series(_minute_points(t), METRICS)


FILL = ", ".join(
    f"last_value({m} IGNORE NULLS) OVER (ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS {m}" for m in POWER_MEASURES
)
FILL_SQL = f"SELECT * FROM (SELECT timestamp, {FILL} FROM ({MERGE_SQL})) WHERE consumption_mw IS NOT NULL"


@query("w6_forward_fill", FILL_SQL)
def _(t):
    return joins.merge_and_fill(_minute_points(t))


@query("w6_forward_fill_split", FILL_SQL)
def _(t):
    return joins.merge_and_fill(_minute_points(t), max_rows=SPLIT_ROWS)


FILL_KEYED = ", ".join(
    f"last_value({m} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS {m}"
    for m in POWER_MEASURES
)


@query(
    "w6_forward_fill_keyed",
    f"SELECT * FROM (SELECT user_id, time, {FILL_KEYED} FROM power) WHERE consumption_mw IS NOT NULL",
)
def _(t):
    rows = t.power.select("user_id", "time", *POWER_MEASURES)
    return joins.forward_fill(rows, POWER_MEASURES, time="time", keys=["user_id"])


# All weather rows seven minutes later: no row of the left side meets its own event.
LATER_WEATHER = "(SELECT * REPLACE (time + INTERVAL 7 MINUTE AS time) FROM weather)"


def later_weather(t):
    return t.weather.withColumn("time", F.col("time") + F.expr("INTERVAL 7 MINUTES"))


BACKWARD_SQL = f"""
    SELECT p.time, p.event_id, p.consumption_mw, w.time AS weather_time, w.temperature_c, w.wind_speed_ms
    FROM power p ASOF LEFT JOIN {LATER_WEATHER} w ON p.time >= w.time"""


def _backward(t, **options):
    return asof_backward(
        t.power.select("time", "event_id", "consumption_mw"), later_weather(t),
        columns=["temperature_c", "wind_speed_ms"], matched_time="weather_time", **options,
    )


@query("j3_asof_backward", BACKWARD_SQL)
def _(t):
    return _backward(t)


@query("j3_asof_backward_split", BACKWARD_SQL)
def _(t):
    return _backward(t, max_rows=SPLIT_ROWS)


@query(
    "j3_asof_backward_keyed",
    f"""
    SELECT p.time, p.event_id, p.station_id, p.temperature_c AS observed_c, w.time AS weather_time, w.temperature_c
    FROM weather p ASOF LEFT JOIN {LATER_WEATHER} w ON p.station_id = w.station_id AND p.time >= w.time""",
)
def _(t):
    observed = t.weather.select("time", "event_id", "station_id", F.col("temperature_c").alias("observed_c"))
    return asof_backward(
        observed, later_weather(t), keys=["station_id"], columns=["temperature_c"], matched_time="weather_time",
    )


NEAREST_SQL = f"""
    WITH w AS (SELECT time AS wt, temperature_c, pressure_hpa FROM {LATER_WEATHER}),
    b AS (SELECT p.time, p.event_id, w.wt, w.temperature_c, w.pressure_hpa FROM power p ASOF LEFT JOIN w ON p.time >= w.wt),
    f AS (SELECT p.event_id, w.wt, w.temperature_c, w.pressure_hpa FROM power p ASOF LEFT JOIN w ON p.time <= w.wt)
    MAIN SELECT time, event_id, weather_time, temperature_c, pressure_hpa FROM (
        SELECT b.time, b.event_id,
               CASE WHEN later THEN f.wt ELSE b.wt END AS weather_time,
               CASE WHEN later THEN f.temperature_c ELSE b.temperature_c END AS temperature_c,
               CASE WHEN later THEN f.pressure_hpa ELSE b.pressure_hpa END AS pressure_hpa
        FROM (SELECT b.*, f.wt IS NOT NULL AND (b.wt IS NULL OR f.wt - b.time <= b.time - b.wt) AS later
              FROM b JOIN f USING (event_id)) b JOIN f USING (event_id)
    ) WHERE weather_time BETWEEN time - INTERVAL 30 MINUTE AND time + INTERVAL 30 MINUTE"""


def _nearest(t, **options):
    return asof_nearest(
        t.power.select("time", "event_id"), later_weather(t),
        columns=["temperature_c", "pressure_hpa"], required="temperature_c", matched_time="weather_time",
        **options,
    )


@query("j2_asof_nearest", NEAREST_SQL)
def _(t):
    return _nearest(t)


@query("j2_asof_nearest_split", NEAREST_SQL)
def _(t):
    return _nearest(t, max_rows=SPLIT_ROWS)


@query(
    "a1_align_hourly",
    """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS timestamp, user_id, avg(temperature_c) AS temperature_c,
              avg(wind_speed_ms) AS wind_speed_ms FROM weather GROUP BY 1, 2""",
    rounded="temperature_c wind_speed_ms",
)
def _(t):
    return resample.align_to_hourly(t.weather.select("time", "user_id", "temperature_c", "wind_speed_ms"), ["user_id"])


@query(
    "a2_resample_power",
    """SELECT CAST(time_bucket(INTERVAL 15 MINUTE, time) AS TIMESTAMP) AS time, avg(consumption_mw) AS consumption_mw,
              avg(production_mw) AS production_mw, avg(wind_mw) AS wind_mw, avg(nuclear_mw) AS nuclear_mw,
              avg(net_import_mw) AS net_import_mw FROM power GROUP BY 1""",
    rounded=" ".join(POWER_MEASURES),
)
def _(t):
    return resample.resample_power(t.power, "15 minutes")


@query(
    "a3_resample_prices",
    """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, area, avg(price_eur_mwh) AS price_eur_mwh
       FROM prices GROUP BY 1, 2""",
    rounded="price_eur_mwh",
)
def _(t):
    return resample.resample_prices(t.prices, "1 hour", keys=["area"])


A4_SQL = """
    SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, avg(temperature_c) AS temperature_c,
           avg(wind_speed_ms) AS wind_speed_ms, avg(wind_direction) AS wind_direction, avg(cloud_cover) AS cloud_cover,
           avg(humidity_percent) AS humidity_percent, avg(pressure_hpa) AS pressure_hpa,
           coalesce(sum(precipitation_mm), 0) AS precipitation_mm
    FROM weather WHERE station_id = (SELECT arg_min(station_id, time) FROM weather) GROUP BY 1"""


@query("a4_resample_weather", A4_SQL, rounded=" ".join(WEATHER_MEASURES))
def _(t):
    return resample.resample_weather(t.weather)


@query(
    "j4_join_prices_weather",
    f"""
    WITH pr AS (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, avg(price_eur_mwh) AS price_eur_mwh
                FROM prices WHERE area = 'FI' GROUP BY 1),
    we AS ({A4_SQL})
    MAIN SELECT h.*, pr.price_eur_mwh, we.* EXCLUDE (time) FROM hourly h LEFT JOIN pr USING (time) LEFT JOIN we USING (time)""",
    rounded=" ".join(["price_eur_mwh", *POWER_MEASURES, *WEATHER_MEASURES]),
)
def _(t):
    from seriesmill.plans.datasets import hourly_inputs

    return hourly_inputs(t.power, t.prices.where(F.col("area") == "FI"), t.weather)


PIVOT_SQL = """
    SELECT forecast_time, max(CASE WHEN forecast_type = 'consumption' THEN value END) AS consumption_forecast_mw,
           max(CASE WHEN forecast_type = 'production' THEN value END) AS production_forecast_mw,
           max(CASE WHEN forecast_type = 'wind' THEN value END) AS wind_forecast_mw
    FROM (SELECT DISTINCT ON (forecast_time, forecast_type) * FROM forecasts
          WHERE forecast_type IN ('consumption', 'production', 'wind')
          ORDER BY forecast_time, forecast_type, generated_at DESC)
    GROUP BY 1"""


def _pivoted(t):
    newest = latest.latest_per_key(t.forecasts, ["forecast_time", "forecast_type"], ["generated_at"])
    return joins.pivot_power_forecasts(newest)


@query("a28_pivot_forecasts", PIVOT_SQL)
def _(t):
    return _pivoted(t)


@query(
    "j5_weather_with_power_forecasts",
    f"""
    WITH w AS (SELECT DISTINCT ON (forecast_time, station_id) * FROM weather_forecasts
               ORDER BY forecast_time, station_id, generated_at DESC),
    p AS ({PIVOT_SQL})
    MAIN SELECT w.forecast_time, station_id, temperature_c, wind_speed_ms, consumption_forecast_mw,
           production_forecast_mw, wind_forecast_mw FROM w LEFT JOIN p USING (forecast_time)""",
)
def _(t):
    weather = latest.latest_per_key(t.weather_forecasts, ["forecast_time", "station_id"], ["generated_at"])
    return weather.select("forecast_time", "station_id", "temperature_c", "wind_speed_ms").join(
        _pivoted(t), "forecast_time", "left"
    )


@query(
    "j9_newest_run",
    """SELECT timestamp, model_type, predicted_consumption_mw, generated_at FROM predictions
       WHERE generated_at = (SELECT max(generated_at) FROM predictions)""",
)
def _(t):
    return latest.latest_run_rows(t.predictions, "generated_at").select(
        "timestamp", "model_type", "predicted_consumption_mw", "generated_at"
    )


@query(
    "j10_newest_run_per_model",
    """SELECT DISTINCT ON (model_type, timestamp) timestamp, model_type, predicted_consumption_mw, model_version, generated_at
       FROM predictions p
       WHERE generated_at = (SELECT max(generated_at) FROM predictions q WHERE q.model_type = p.model_type)
       ORDER BY model_type, timestamp, generated_at DESC""",
)
def _(t):
    return latest.latest_predictions_per_model(t.predictions).select(
        "timestamp", "model_type", "predicted_consumption_mw", "model_version", "generated_at"
    )


@query(
    "j12_exists",
    "SELECT EXISTS (SELECT 1 FROM price_predictions WHERE generated_at >= TIMESTAMP '2024-01-25 06:00:00') AS has_recent",
)
def _(t):
    recent = F.col("generated_at") >= F.lit("2024-01-25 06:00:00").cast("timestamp_ntz")
    return joins.any_row(t.price_predictions, recent, "has_recent")


@query(
    "j13_absent_keys",
    """SELECT p.time, p.area, p.price_eur_mwh FROM prices p
       WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.time = date_trunc('minute', p.time) AND o.area = p.area)""",
)
def _(t):
    batch = t.prices.select("time", "area", "price_eur_mwh").withColumn(
        "minute", F.date_trunc("minute", "time").cast("timestamp_ntz")
    )
    target = t.outcomes.select(F.col("time").alias("minute"), "area")
    return joins.absent_rows(batch, target, ["minute", "area"]).drop("minute")


@query(
    "w7_latest_run",
    """SELECT DISTINCT ON (timestamp, model_type) timestamp, model_type, predicted_consumption_mw, confidence_lower,
              confidence_upper, generated_at FROM predictions ORDER BY timestamp, model_type, generated_at DESC""",
)
def _(t):
    rows = t.predictions.drop("model_version")
    return latest.latest_per_key(rows, ["timestamp", "model_type"], ["generated_at"])


@query(
    "w12_current_weather",
    """SELECT DISTINCT ON (station_id) station_id, time, temperature_c, humidity_percent, wind_speed_ms, pressure_hpa, cloud_cover
       FROM weather WHERE data_type = 'observation' ORDER BY station_id, time DESC""",
)
def _(t):
    return latest.current_weather(t.weather).select(
        "station_id", "time", "temperature_c", "humidity_percent", "wind_speed_ms", "pressure_hpa", "cloud_cover"
    )


@query(
    "w13_status",
    """SELECT timestamp, model_type, model_version, generated_at FROM predictions
       ORDER BY generated_at DESC, timestamp DESC LIMIT 1""",
)
def _(t):
    return latest.status(t.predictions).select("timestamp", "model_type", "model_version", "generated_at")


@query(
    "w10_last_known",
    """SELECT user_id, arg_max_null(production_mw, time) AS production_mw, arg_max_null(wind_mw, time) AS wind_mw
       FROM power GROUP BY user_id""",
)
def _(t):
    return latest.last_known(t.power, "time", ["production_mw", "wind_mw"], ["user_id"])


P17_SQL = """
    SELECT DISTINCT ON (time, area) time, area, price_eur_mwh FROM (
        SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, area, price_eur_mwh, event_id FROM prices
    ) ORDER BY time, area, event_id DESC"""


def _keep_last(t):
    rows = t.prices.select(
        F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time"), "area", "price_eur_mwh", "event_id"
    )
    return latest.latest_per_key(rows, ["time", "area"], ["event_id"]).drop("event_id")


@query("p17_keep_last", P17_SQL)
def _(t):
    return _keep_last(t)


@query(
    "u4_distinct_keep_last",
    """SELECT time, station_id, data_type, temperature_c FROM (SELECT *, CAST(date_trunc('hour', time) AS TIMESTAMP) AS time_ FROM weather)
       QUALIFY row_number() OVER (PARTITION BY time_, station_id, data_type ORDER BY event_id DESC) = 1""",
)
def _(t):
    """The last row of each hour, station and kind, by arrival."""
    rows = t.weather.select("time", "station_id", "data_type", "temperature_c", "event_id").withColumn("hour", F.date_trunc("hour", "time"))
    return latest.latest_per_key(rows, ["hour", "station_id", "data_type"], ["event_id"]).drop("hour", "event_id")


@query(
    "w9_chronological_split",
    """SELECT time, event_id, CASE WHEN row_number() OVER (ORDER BY time, event_id) <= floor(count(*) OVER () * 0.8)
              THEN 'train' ELSE 'test' END AS part FROM prices""",
)
def _(t):
    train, test = chronological_split(t.prices, 0.2, "time", tie_break=["event_id"])
    return train.select("time", "event_id", F.lit("train").alias("part")).unionByName(
        test.select("time", "event_id", F.lit("test").alias("part"))
    )


Q14_SQL = f"""
    SELECT p.time, p.consumption_mw, p.production_mw, p.wind_mw, p.nuclear_mw, p.net_import_mw,
           w.temperature_c AS temperature, w.wind_speed_ms AS wind_speed, w.wind_direction, w.cloud_cover,
           w.humidity_percent AS humidity, w.pressure_hpa AS pressure, w.precipitation_mm
    FROM (SELECT * FROM power WHERE time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') p
    ASOF LEFT JOIN weather w ON p.time >= w.time"""


@query("q14_training_rows", Q14_SQL)
def _(t):
    return joined_training_data(t.power, t.weather, START, END)
