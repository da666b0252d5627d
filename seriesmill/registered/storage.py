"""Registered queries: scans, payload decoding, sinks, ingest jobs, row operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.timecols import floor_time
from seriesmill.operators import evaluation as ev
from seriesmill.plans import ingest
from seriesmill.plans.models import as_doubles
from seriesmill.plans.reports import zero_if_null
from seriesmill.registered.base import AS_OF, END, START, naive, query
from seriesmill.registered.temporal import FILL
from seriesmill.schemas import POWER_MEASURES
from seriesmill.session import scratch_path
from seriesmill.sinks import tables
from seriesmill.sources import payloads, scans, windows

SPAN = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
FIVE = ", ".join(POWER_MEASURES)

# --- scans --------------------------------------------------------------------------------


@query("s1_power_range", f"SELECT time, {FIVE} FROM power WHERE time {SPAN}")
def _(t):
    return scans.power_actuals(t.power, START, END).orderBy("time")


@query("s2_prices_area", f"SELECT time, price_eur_mwh, area, price_type FROM prices WHERE time {SPAN} AND area = 'FI'")
def _(t):
    return scans.prices(t.prices, START, END)


@query(
    "s3_weather_station",
    f"""SELECT time, station_id, temperature_c AS temperature, wind_speed_ms AS wind_speed, wind_direction, cloud_cover,
              humidity_percent AS humidity, pressure_hpa AS pressure, precipitation_mm FROM weather
       WHERE time {SPAN} AND station_id = 's1'""",
)
def _(t):
    return scans.weather(t.weather, START, END, "s1")


@query(
    "s4_weather_forecasts",
    f"""SELECT DISTINCT ON (forecast_time, station_id) * FROM weather_forecasts
       WHERE forecast_time {SPAN} AND forecast_model = 'harmonie' ORDER BY forecast_time, station_id, generated_at DESC""",
)
def _(t):
    return scans.weather_forecasts(t.weather_forecasts, START, END, model="harmonie")


@query(
    "s5_power_forecasts",
    f"""SELECT DISTINCT ON (forecast_time, forecast_type) * FROM forecasts
       WHERE forecast_time {SPAN} AND forecast_type IN ('consumption', 'wind', 'price') ORDER BY forecast_time, forecast_type, generated_at DESC""",
)
def _(t):
    return scans.power_forecasts(t.forecasts, START, END, ["consumption", "wind", "price"])


@query("s6_newest_snapshot", f"SELECT time, {FIVE} FROM hourly", rounded=" ".join(POWER_MEASURES))
def _(t):
    root = scratch_path(t.spark, "snapshots")
    tables.snapshot(t.power.select("time", *POWER_MEASURES), root, "2024-01-24")
    tables.snapshot(t.hourly, root, "2024-01-25")
    return scans.newest_snapshot(t.spark, root)


@query(
    "s7_sql_scan",
    f"SELECT time, price_eur_mwh, CAST(event_id AS DOUBLE) AS event_id FROM prices WHERE area = 'SE' AND time >= TIMESTAMP '{START}'",
)
def _(t):
    return scans.sql_scan(
        t.spark, "SELECT time, price_eur_mwh, event_id FROM {prices} WHERE area = :area AND time >= CAST(:start AS TIMESTAMP_NTZ)",
        {"prices": t.prices}, {"area": "SE", "start": START}, {"event_id": "double"},
    )


@query(
    "s15_last_hours",
    f"SELECT time, station_id, temperature_c FROM weather WHERE time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}'",
)
def _(t):
    return scans.last_hours(t.weather, "time", 24, AS_OF).select("time", "station_id", "temperature_c")


# --- windows and catalogue ----------------------------------------------------------------

SPANS = "SELECT user_id, CAST(date_trunc('second', min(ts)) AS TIMESTAMP) AS a, CAST(date_trunc('second', max(ts)) AS TIMESTAMP) AS b FROM events GROUP BY 1"


def _spans(t):
    second = [F.date_trunc("second", f("ts")).cast("timestamp_ntz").alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]
    return t.events.groupBy("user_id").agg(*second)


@query(
    "s13_request_windows",
    f"""SELECT user_id, window_start, least(window_start + INTERVAL 60 HOUR, b) AS window_end
       FROM (SELECT user_id, b, unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 60 HOUR)) AS window_start FROM ({SPANS}))""",
)
def _(t):
    return windows.half_open_windows(_spans(t), "a", "b", 60).select("user_id", "window_start", "window_end")


@query(
    "s13_weather_windows",
    f"""SELECT user_id, window_start, least(window_start + INTERVAL 168 HOUR, b) AS window_end
       FROM (SELECT user_id, b, unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 604801 SECOND)) AS window_start FROM ({SPANS}))""",
)
def _(t):
    return windows.weather_windows(_spans(t), "a", "b").select("user_id", "window_start", "window_end")


DATASET_ID = "CASE metric WHEN 'consumption' THEN 124 WHEN 'production' THEN 192 WHEN 'wind' THEN 75 WHEN 'nuclear' THEN 188 ELSE 194 END"


def _dataset_points(t, time="timestamp"):
    code = (
        F.when(F.col("metric") == "consumption", 124).when(F.col("metric") == "production", 192)
        .when(F.col("metric") == "wind", 75).when(F.col("metric") == "nuclear", 188).otherwise(194)
    )
    return t.points.select(code.alias("dataset_id"), F.col("time").alias(time), "value")


@query(
    "s14_catalogue",
    f"""SELECT {DATASET_ID} AS dataset_id, metric, 'MW' AS unit,
              CASE WHEN metric = 'wind' THEN '15min' ELSE '3min' END AS update_frequency, count(*) AS points
       FROM points GROUP BY ALL""",
)
def _(t):
    named = ingest.with_catalogue(_dataset_points(t), "actual")
    return named.groupBy("dataset_id", "metric", "unit", "update_frequency").agg(F.count(F.lit(1)).alias("points"))


# --- payloads -----------------------------------------------------------------------------


def _iso(column):
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def point_payloads(t):
    """One response per event: camel-case keys for some event types, snake-case for others."""
    later = F.col("time") + F.expr("INTERVAL 3 MINUTES")
    camel = F.col("metric").isin("consumption", "wind")
    keys = [F.when(camel, a).otherwise(b) for a, b in (("startTime", "start_time"), ("endTime", "end_time"))]
    text = F.concat(
        F.lit('{"data": [{"'), keys[0], F.lit('": "'), _iso(F.col("time")), F.lit('", "'), keys[1], F.lit('": "'),
        _iso(later), F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "quality": "ok"}], "pagination": {"page": 1}}'),
    )
    return t.points.select("event_id", F.col("metric").alias("dataset_id"), text.alias("payload"))


@query("s8_decode_points", "SELECT event_id, time AS start_time, time + INTERVAL 3 MINUTE AS end_time, value FROM points")
def _(t):
    rows = payloads.decode_points(point_payloads(t), "payload").drop("dataset_id")
    return naive(rows, "start_time", "end_time")


def damaged(rows):
    """Three in seven payloads are missing, cut off, or without content."""
    p, k = F.col("payload"), F.col("event_id") % 7
    return rows.withColumn("payload", F.when(k == 1, None).when(k == 2, F.substring(p, F.lit(1), F.length(p) - 5)).when(k == 3, "{}").otherwise(p))


REJECTS = """
    SELECT coalesce(reason, 'accepted') AS reason, count(*) AS payloads, CAST(sum(event_id) AS BIGINT) AS ids
    FROM (SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'empty' {} END AS reason FROM {})
    GROUP BY 1"""


def _accounted(accepted, rejected):
    """Payloads and ids by reason; the accepted ones come from the decoded rows."""
    return accepted.select("event_id", F.lit("accepted").alias("reason")).unionByName(rejected.select("event_id", "reason")).groupBy(
        "reason").agg(F.count(F.lit(1)).alias("payloads"), F.sum("event_id").alias("ids"))


@query("s8_rejected_points", REJECTS.format("", "points"))
def _(t):
    rows = damaged(point_payloads(t))
    return _accounted(payloads.decode_points(rows, "payload"), payloads.rejected_points(rows, "payload"))


@query("s12_points_to_frame", "SELECT event_id, time AS timestamp, value AS wind_mw FROM points")
def _(t):
    rows = payloads.decode_points(point_payloads(t), "payload")
    return naive(payloads.points_to_frame(rows, "wind_mw", ("event_id",)), "timestamp")


@query("i8_concatenate_chunks", "SELECT metric AS dataset_id, time AS start_time, value FROM points")
def _(t):
    rows = ingest.concatenate_chunks(point_payloads(t).drop("event_id"))
    return naive(rows.select("dataset_id", "start_time", "value"), "start_time")


def _reading(parameter, column):
    return F.concat(
        F.lit(f'"{parameter}": {{"value": '), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(', "units": "x"}')
    )


def weather_payloads(t, forecast=False):
    """One payload per row of `weather`, in both shapes; the second also holds another station."""
    def body(names):
        columns = {
            "temperature": "temperature_c", "humidity": "humidity_percent", "wind_speed": "wind_speed_ms",
            "wind_direction": "wind_direction", "pressure": "pressure_hpa", "precipitation": "precipitation_mm",
            "cloud_cover": "cloud_cover",
        }
        parts = [_reading(names[c], column) for c, column in columns.items()]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    by_station = payloads.FORECAST_BY_STATION_PARAMETERS if forecast else payloads.OBSERVATION_PARAMETERS
    by_time = payloads.FORECAST_BY_TIME_PARAMETERS if forecast else payloads.OBSERVATION_PARAMETERS
    hour = _iso(floor_time(t.weather, "time", "1 hour"))
    first = F.concat(F.lit('{"'), F.col("station_id"), F.lit('": {"'), hour, F.lit('": '), body(by_station), F.lit("}}"))
    name = F.concat(F.lit("Station "), F.col("station_id"))
    shown = name if forecast else F.upper(name)
    second = F.concat(
        F.lit('{"'), hour, F.lit('": {"Elsewhere": {"'), F.lit(by_time["temperature"]), F.lit('": {"value": 99.0, "units": "x"}}, "'),
        shown, F.lit('": '), body(by_time), F.lit("}}"),
    )
    return t.weather.select(
        "station_id", name.alias("station_name"), "event_id",
        F.when(F.col("data_type") == "forecast", first).otherwise(second).alias("payload"),
    )


DECODED = """
    SELECT DISTINCT ON (station_id, timestamp) station_id, timestamp, temperature_c AS temperature, humidity_percent AS humidity,
           wind_speed_ms AS wind_speed, wind_direction, pressure_hpa AS pressure, precipitation_mm AS precipitation, cloud_cover
    FROM (SELECT *, CAST(date_trunc('hour', time) AS TIMESTAMP) AS timestamp FROM weather)
    ORDER BY station_id, timestamp, event_id DESC"""


@query("s9_decode_observations", DECODED)
def _(t):
    rows = payloads.decode_weather(weather_payloads(t), "payload", "station_id", "station_name", order="event_id")
    return naive(rows, "timestamp")


@query("s10_decode_forecasts", DECODED)
def _(t):
    rows = payloads.decode_weather(
        weather_payloads(t, forecast=True), "payload", "station_id", "station_name", forecast=True, order="event_id"
    )
    return naive(rows, "timestamp")


def damaged_weather(t, forecast):
    """Damaged as above; one in seven has no reading of its station."""
    other = F.lit('{"Nowhere": {}}') if forecast else F.concat(F.lit('{"'), F.col("station_id"), F.lit('": {}}'))
    rows = damaged(weather_payloads(t, forecast))
    return rows.withColumn("payload", F.when(F.col("event_id") % 7 == 4, other).otherwise(F.col("payload")))


WEATHER_REJECTS = """
    SELECT event_id, station_id, CASE event_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'empty'
                                     ELSE 'no reading of the station' END AS reason
    FROM weather WHERE event_id % 7 BETWEEN 1 AND 4"""

for key, forecast in (("s9_rejected_observations", False), ("s10_rejected_forecasts", True)):
    @query(key, WEATHER_REJECTS)
    def _(t, forecast=forecast):
        found = payloads.rejected_weather(damaged_weather(t, forecast), "payload", "station_id", "station_name", forecast=forecast)
        return found.select("event_id", "station_id", "reason")

for key, forecast in (("s9_decode_damaged", False), ("s10_decode_damaged", True)):
    @query(key, DECODED.replace("FROM weather)", "FROM weather WHERE event_id % 7 NOT BETWEEN 1 AND 4)"))
    def _(t, forecast=forecast):
        rows = payloads.decode_weather(
            damaged_weather(t, forecast), "payload", "station_id", "station_name", forecast=forecast, order="event_id")
        return naive(rows, "timestamp")


@query(
    "s11_station_coordinates",
    """SELECT event_id, 60 + value / 100 AS latitude, 24 + value / 50 AS longitude,
              CASE WHEN event_type = 'click' THEN 'Unknown' ELSE 'Kumpula' END AS station_name FROM events""",
    rounded="latitude longitude",
)
def _(t):
    lat, lon = (60 + F.col("value") / 100).cast("string"), (24 + F.col("value") / 50).cast("string")
    sid = F.col("event_id").cast("string")

    def meta(key, *fields):
        return F.concat(F.lit('{"0x": {"name": "Other"}, "'), key, F.lit('": {'), F.concat_ws(", ", *fields), F.lit("}}"))

    def field(name, value):
        return F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))

    name = F.lit('"name": "Kumpula"')
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", meta(sid, name, field("latitude", lat), field("longitude", lon)))
        .when(kind == "click", meta(F.concat(F.lit("0"), sid), field("lat", F.concat(F.lit("("), lat, F.lit(")"))), field("lon", lon)))
        .when(kind == "purchase", meta(F.lit("key"), name, field("fmisid", sid), field("wgs84", F.concat(lat, F.lit(", "), lon))))
        .when(kind == "signup", meta(F.lit("key"), name, field("stationId", sid),
              field("wgs84_center", F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")")))))
        .otherwise(meta(sid, name, field("wgs84", F.concat(lat, F.lit(","), lon)), field("lat", F.lit("1"))))
    )
    rows = t.events.select(sid.alias("station"), body.alias("body"))
    found = payloads.station_coordinates(rows, "station", "body")
    return found.select(F.col("station").cast("long").alias("event_id"), "latitude", "longitude", "station_name")


# --- sinks --------------------------------------------------------------------------------

MINUTE = "CAST(date_trunc('minute', {}) AS TIMESTAMP)"


def _power_batch(t, shift=None):
    at = F.date_trunc("minute", F.col("time") + F.expr(f"INTERVAL {shift or '0 MINUTES'}")).cast("timestamp_ntz")
    return t.power.select(at.alias("timestamp"), "event_id", *POWER_MEASURES)


def _batches(shift):
    return f"""
    b AS (SELECT {MINUTE.format('time')} AS time, event_id, {FIVE}, 1 AS batch FROM power
          UNION ALL SELECT {MINUTE.format(f"time + INTERVAL {shift}")}, event_id, {FIVE}, 2 FROM power)"""


@query(
    "k1_upsert_power",
    f"""WITH {_batches('30 MINUTE').strip()}
    MAIN SELECT DISTINCT ON (time) time, {FIVE}, CASE min(batch) OVER (PARTITION BY time) WHEN 1 THEN 'first' ELSE 'second' END AS source
    FROM b ORDER BY time, batch DESC, event_id DESC""",
)
def _(t):
    """Two batches; on conflict the measures are replaced and the other columns stay."""
    path = scratch_path(t.spark, "power")
    for shift, source in ((None, "first"), ("30 MINUTES", "second")):
        tables.store_power(_power_batch(t, shift).withColumn("source", F.lit(source)), path, order=["event_id"])
    return tables.read_table(t.spark, path).select("time", *POWER_MEASURES, "source")


@query(
    "k2_insert_prices",
    f"""WITH b AS (SELECT {MINUTE.format('time')} AS time, price_eur_mwh, 1 AS batch FROM prices
                   UNION ALL SELECT {MINUTE.format('time + INTERVAL 30 MINUTE')}, price_eur_mwh, 2 FROM prices)
    MAIN SELECT DISTINCT ON (time) time, price_eur_mwh, 'FI' AS area, 'imbalance' AS price_type, 'fingrid' AS source
    FROM b ORDER BY time, batch, price_eur_mwh""",
)
def _(t):
    path = scratch_path(t.spark, "prices")
    for shift in ("0 MINUTES", "30 MINUTES"):
        at = F.date_trunc("minute", F.col("time") + F.expr(f"INTERVAL {shift}")).cast("timestamp_ntz")
        tables.store_prices(t.prices.select(at.alias("timestamp"), "price_eur_mwh"), path)
    return tables.read_table(t.spark, path).select("time", "price_eur_mwh", "area", "price_type", "source")


K3_ROWS = """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, station_id, data_type, max(temperature_c) AS temperature_c,
    max(CAST(trunc(cloud_cover * 0.7) AS INTEGER)) AS cloud_cover FROM weather GROUP BY 1, 2, 3"""


@query("k3_upsert_weather", K3_ROWS)
def _(t):
    """Cloud cover comes as a fraction or NaN; the second batch repeats the first (idempotent)."""
    path = scratch_path(t.spark, "weather")
    hour = floor_time(t.weather, "time", "1 hour")
    rows = t.weather.groupBy(hour.alias("timestamp"), "station_id", "data_type").agg(
        F.max("temperature_c").alias("temperature_c"), (F.max("cloud_cover") * 0.7).alias("cloud_cover")
    )
    nan = rows.withColumn("cloud_cover", F.lit(float("nan")))
    for batch in (nan, rows, rows):
        tables.store_weather(batch.where(F.col("data_type") == "observation"), path)
        tables.store_weather(batch.where(F.col("data_type") == "forecast"), path, data_type="forecast")
    return tables.read_table(t.spark, path).select("time", "station_id", "data_type", "temperature_c", "cloud_cover")


@query(
    "k4_append_weather_forecast",
    f"""SELECT time AS forecast_time, station_id, temperature_c, 'harmonie' AS forecast_model, TIMESTAMP '{AS_OF}' AS generated_at
       FROM weather""",
)
def _(t):
    path = scratch_path(t.spark, "weather_forecasts")
    rows = t.weather.select(F.col("time").alias("timestamp"), "station_id", "temperature_c")
    tables.store_weather_forecast(rows, path, station_id=None, model="harmonie", generated_at=AS_OF)
    return tables.read_table(t.spark, path).select("forecast_time", "station_id", "temperature_c", "forecast_model", "generated_at")


@query(
    "k5_append_power_forecast",
    f"""SELECT time AS forecast_time, 'wind' AS forecast_type, value, 'MW' AS unit, '15min' AS update_frequency,
              TIMESTAMP '{AS_OF}' AS generated_at FROM points""",
)
def _(t):
    path = scratch_path(t.spark, "power_forecasts")
    rows = t.points.select(F.col("time").alias("timestamp"), "value")
    tables.store_power_forecast(
        rows, path, generated_at=AS_OF, forecast_type="wind", unit="MW", update_frequency="15min"
    )
    return tables.read_table(t.spark, path).select(
        "forecast_time", "forecast_type", "value", "unit", "update_frequency", "generated_at"
    )


@query(
    "k6_append_price_predictions",
    f"""SELECT time AS prediction_time, price_eur_mwh AS predicted_price_eur_mwh, price_eur_mwh - 1 AS confidence_lower,
              price_eur_mwh + 1 AS confidence_upper, 'production' AS model_type, 'v7' AS model_version,
              TIMESTAMP '{AS_OF}' AS generated_at, TIMESTAMP '{START}' AS training_end_date FROM prices""",
)
def _(t):
    path = scratch_path(t.spark, "price_predictions")
    p = F.col("price_eur_mwh")
    rows = t.prices.select(F.col("time").alias("timestamp"), p.alias("yhat"), (p - 1).alias("yhat_lower"), (p + 1).alias("yhat_upper"))
    tables.store_price_predictions(
        rows, path, model_type="production", generated_at=AS_OF, model_version="v7", training_end=START
    )
    return tables.read_table(t.spark, path).select(
        "prediction_time", "predicted_price_eur_mwh", "confidence_lower", "confidence_upper", "model_type",
        "model_version", "generated_at", "training_end_date",
    )


@query(
    "k7_upsert_predictions",
    f"""SELECT timestamp, max(predicted_consumption_mw) AS predicted_consumption_mw, max(confidence_lower) AS confidence_lower,
              max(confidence_upper) AS confidence_upper, 'lightgbm' AS model_type, 'second' AS model_version,
              TIMESTAMP '{AS_OF}' AS generated_at FROM predictions GROUP BY timestamp""",
)
def _(t):
    path = scratch_path(t.spark, "consumption_predictions")
    names = ["predicted_consumption_mw", "confidence_lower", "confidence_upper"]
    for pick, version in ((F.min, "first"), (F.max, "second")):
        rows = t.predictions.groupBy("timestamp").agg(*[pick(n).alias(n) for n in names])
        tables.store_consumption_predictions(
            rows.withColumn("model_version", F.lit(version)), path, model_type="lightgbm", generated_at=AS_OF
        )
    return tables.read_table(t.spark, path).select("timestamp", *names, "model_type", "model_version", "generated_at")


@query("k8_snapshot", "SELECT time, area, price_eur_mwh FROM prices")
def _(t):
    root = scratch_path(t.spark, "price_snapshot")
    tables.snapshot(t.prices.select("time", "area", "price_eur_mwh"), root, "2024-01-25")
    return t.spark.read.parquet(root).drop("snapshot_date")


@query("k9_time_partitions", "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS day, count(*) AS row_count FROM prices GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "partitioned")
    tables.append(tables.conform(t.prices, "price_actuals"), path, "price_actuals")
    return tables.read_table(t.spark, path).groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "k10_retention",
    "SELECT forecast_time, forecast_type, value FROM forecasts WHERE CAST(forecast_time AS DATE) >= DATE '2024-01-15'",
)
def _(t):
    path = scratch_path(t.spark, "expiring")
    tables.append(tables.conform(t.forecasts, "power_forecasts"), path, "power_forecasts")
    tables.apply_retention(t.spark, path, "power_forecasts", "2024-04-14 10:00:00")
    return tables.read_table(t.spark, path).select("forecast_time", "forecast_type", "value")


@query(
    "k11_conform",
    """SELECT time, value AS consumption_mw, CAST(NULL AS DOUBLE) AS production_mw, CAST(NULL AS DOUBLE) AS wind_mw,
              CAST(NULL AS DOUBLE) AS nuclear_mw, CAST(NULL AS DOUBLE) AS net_import_mw, CAST(NULL AS VARCHAR) AS source,
              CAST(NULL AS TIMESTAMP) AS ingested_at FROM points""",
)
def _(t):
    rows = t.points.select(F.col("time").alias("timestamp"), F.col("value").alias("consumption"), "event_id")
    return naive(tables.conform(rows, "power_actuals", tables.POWER_ALIASES), "ingested_at")


K12_SQL = """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS hour, count(*) AS num_predictions, avg(ml_absolute_error) AS ml_avg_error
    FROM comparison WHERE actual_price IS NOT NULL GROUP BY 1"""


def _refresh_views(t):
    """Comparison first, then the hourly performance from the stored comparison."""
    first = scratch_path(t.spark, "comparison")
    second = scratch_path(t.spark, "performance")
    compute = lambda: ev.price_comparison(t.price_predictions, t.forecasts, t.outcomes, AS_OF)
    for _ in range(2):
        stored = tables.refresh(t.spark, first, compute)
        tables.refresh(t.spark, second, lambda: ev.performance_hourly(stored))
    return second


@query("k12_refresh_views", K12_SQL, rounded="ml_avg_error")
def _(t):
    path = _refresh_views(t)
    return tables.current(t.spark, path).select("hour", "num_predictions", "ml_avg_error")


@query("k13_lazy_first_fill", K12_SQL, rounded="ml_avg_error")
def _(t):
    path = scratch_path(t.spark, "lazy")

    def fill():
        return ev.performance_hourly(ev.price_comparison(t.price_predictions, t.forecasts, t.outcomes, AS_OF))

    tables.current_or_refresh(t.spark, path, fill)
    return tables.current_or_refresh(t.spark, path, lambda: fill().limit(0)).select("hour", "num_predictions", "ml_avg_error")


# --- ingest jobs --------------------------------------------------------------------------

ONE = ", ".join(f"max(CASE WHEN metric = '{m.removesuffix('_mw')}' THEN value END) AS {m}" for m in POWER_MEASURES)


@query(
    "i1_ingest_actuals",
    f"""SELECT * FROM (SELECT timestamp AS time, {FILL} FROM (
          SELECT {MINUTE.format('time')} AS timestamp, {ONE} FROM points WHERE date_trunc('minute', time) {SPAN} GROUP BY 1))
       WHERE consumption_mw IS NOT NULL""",
)
def _(t):
    path = scratch_path(t.spark, "actuals")
    points = _dataset_points(t).withColumn("timestamp", F.date_trunc("minute", "timestamp").cast("timestamp_ntz"))
    ingest.ingest_actuals(points, path, START, END)
    return tables.read_table(t.spark, path).select("time", *POWER_MEASURES)


@query(
    "i2_ingest_prices",
    f"""SELECT time, price_eur_mwh FROM prices
       WHERE time BETWEEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 168 HOUR AND TIMESTAMP '{END}'""",
)
def _(t):
    path = scratch_path(t.spark, "ingested_prices")
    points = t.prices.select(F.col("time").alias("timestamp"), F.col("price_eur_mwh").alias("value"))
    ingest.ingest_prices(points, path, "2024-01-10 00:00:00", END)
    return tables.read_table(t.spark, path).select("time", "price_eur_mwh")


@query(
    "i3_ingest_forecasts",
    f"""SELECT time AS forecast_time, CASE metric WHEN 'consumption' THEN 'consumption' WHEN 'production' THEN 'production' ELSE 'wind' END AS forecast_type,
              value, 'MW' AS unit, '15min' AS update_frequency, TIMESTAMP '{AS_OF}' AS generated_at
       FROM points WHERE metric IN ('consumption', 'production', 'wind') AND time {SPAN}""",
)
def _(t):
    path = scratch_path(t.spark, "ingested_forecasts")
    metric = F.col("metric")
    code = F.when(metric == "consumption", 166).when(metric == "production", 241).when(metric == "wind", 245).otherwise(0)
    points = t.points.select(code.alias("dataset_id"), F.col("time").alias("timestamp"), "value")
    ingest.ingest_forecasts(points, path, START, END, AS_OF)
    return tables.read_table(t.spark, path).select(
        "forecast_time", "forecast_type", "value", "unit", "update_frequency", "generated_at"
    )


@query(
    "i4_ingest_weather",
    f"SELECT station_id, timestamp AS time, temperature AS temperature_c, pressure AS pressure_hpa, CAST(trunc(cloud_cover) AS INTEGER) AS cloud_cover, 'observation' AS data_type FROM ({DECODED})",
)
def _(t):
    path = scratch_path(t.spark, "ingested_weather")
    ingest.ingest_weather(weather_payloads(t), path, order="event_id")
    rows = tables.read_table(t.spark, path)
    return naive(rows.select("station_id", "time", "temperature_c", "pressure_hpa", "cloud_cover", "data_type"), "time")


@query(
    "i5_ingest_weather_forecast",
    f"""SELECT forecast_time, station_id, count(*) AS row_count, count(wind_direction) AS with_direction FROM (
          SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS forecast_time, station_id, CAST(NULL AS DOUBLE) AS wind_direction
          FROM weather GROUP BY 1, 2) GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "ingested_weather_forecast")
    ingest.ingest_weather_forecast(weather_payloads(t, forecast=True), path, model="harmonie", run=AS_OF)
    rows = tables.read_table(t.spark, path).groupBy("forecast_time", "station_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("wind_direction").alias("with_direction")
    )
    return naive(rows, "forecast_time")


def backfill_sql(power: int, prices: int, weather: int, forecasts: int | None) -> str:
    last = lambda hours: f"BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR AND TIMESTAMP '{AS_OF}'"
    wanted = f"""SELECT 'power_actuals' AS table_name, count(*) AS row_count FROM (
          SELECT timestamp AS time, {FILL} FROM (SELECT {MINUTE.format('time')} AS timestamp, {ONE} FROM points
              WHERE date_trunc('minute', time) {last(power)} GROUP BY 1)) WHERE consumption_mw IS NOT NULL
        UNION ALL SELECT 'price_actuals', count(DISTINCT time) FROM prices WHERE time {last(prices + 168)}
        UNION ALL SELECT 'weather_observations', count(*) FROM ({DECODED}) WHERE timestamp {last(weather)}"""
    if forecasts is None:
        return wanted
    return wanted + f"""
        UNION ALL SELECT 'power_forecasts', count(*) FROM points
        WHERE metric IN ('consumption', 'production', 'wind') AND time {last(forecasts)}"""


def _ingested(t, hours, with_forecasts: bool):
    """All targets: power, prices, weather and, in the full run, the three kinds of forecasts."""
    metric = F.col("metric")
    code = F.when(metric == "consumption", 166).when(metric == "production", 241).when(metric == "wind", 245).otherwise(0)
    return ingest.backfill(
        t.spark, scratch_path(t.spark, "backfill"), AS_OF, hours,
        power=_dataset_points(t).withColumn("timestamp", F.date_trunc("minute", "timestamp").cast("timestamp_ntz")),
        prices=t.prices.select(F.col("time").alias("timestamp"), F.col("price_eur_mwh").alias("value")),
        forecasts=t.points.select(code.alias("dataset_id"), F.col("time").alias("timestamp"), "value") if with_forecasts else None,
        weather_payloads=weather_payloads(t), weather_order="event_id",
    )


@query("i6_backfill", backfill_sql(720, 720, 720, 720))
def _(t):
    return _ingested(t, 720, True)


@query("i7_short_pull", backfill_sql(6, 72, 6, None))
def _(t):
    return _ingested(t, ingest.SHORT_HOURS, False)


# --- row operations -----------------------------------------------------------------------


@query(
    "p2_union_missing_columns",
    """SELECT time, price_eur_mwh, area, NULL::DOUBLE AS temperature_c FROM prices
       UNION ALL SELECT time, NULL, NULL, temperature_c FROM weather""",
)
def _(t):
    return t.prices.select("time", "price_eur_mwh", "area").unionByName(
        t.weather.select("time", "temperature_c"), allowMissingColumns=True
    )


@query(
    "u2_diagonal_concat",
    """SELECT time, value, metric, NULL::DOUBLE AS price_eur_mwh FROM points UNION ALL SELECT time, NULL, NULL, price_eur_mwh FROM prices""",
)
def _(t):
    return t.points.select("time", "value", "metric").unionByName(
        t.prices.select("time", "price_eur_mwh"), allowMissingColumns=True
    )


@query("u3_vertical_concat", "SELECT time, price_eur_mwh AS value FROM prices UNION ALL SELECT time, temperature_c FROM weather")
def _(t):
    return t.prices.select("time", F.col("price_eur_mwh").alias("value")).unionByName(
        t.weather.select("time", F.col("temperature_c").alias("value"))
    )


@query("p6_closed_window", f"SELECT time, price_eur_mwh FROM prices WHERE time >= TIMESTAMP '{START}' AND time <= TIMESTAMP '{END}'")
def _(t):
    return scans.time_range(t.prices.select("time", "price_eur_mwh"), "time", START, END)


@query("p13_optional_predicates", f"SELECT time, price_eur_mwh, area, price_type FROM prices WHERE time >= TIMESTAMP '{START}' AND area = 'FI' AND price_type = 'day_ahead'")
def _(t):
    return scans.prices(t.prices, START, price_type="day_ahead")


@query("p14_in_list", "SELECT forecast_type, count(*) AS n FROM forecasts WHERE forecast_type IN ('price', 'wind') GROUP BY 1")
def _(t):
    return t.forecasts.where(F.col("forecast_type").isin("price", "wind")).groupBy("forecast_type").agg(F.count(F.lit(1)).alias("n"))


@query("p15_casts", "SELECT event_id, CAST(event_id AS DOUBLE) AS as_double, CAST(user_id AS DOUBLE) AS user_double FROM events")
def _(t):
    rows = t.events.select("event_id", F.col("event_id").alias("as_double"), F.col("user_id").alias("user_double"))
    return as_doubles(rows, ["as_double", "user_double"])


@query(
    "p20_zero_for_null",
    "SELECT event_id, coalesce(precipitation_mm, 0) AS precipitation_mm, temperature_c FROM weather",
)
def _(t):
    return zero_if_null(t.weather.select("event_id", "precipitation_mm", "temperature_c"), ["precipitation_mm", "temperature_c"])


@query("t1_sort_ascending", "SELECT time, value FROM points ORDER BY time")
def _(t):
    return t.points.select("time", "value").orderBy("time")


@query("t2_top_rows", "SELECT time, value FROM points ORDER BY time DESC LIMIT 100")
def _(t):
    return t.points.select("time", "value").orderBy(F.desc("time")).limit(100)


@query("t3_mixed_sort", "SELECT metric, time, value FROM points ORDER BY metric DESC, time")
def _(t):
    return t.points.select("metric", "time", "value").orderBy(F.desc("metric"), "time")


@query("t4_first_rows", f"SELECT time, value FROM points WHERE time >= TIMESTAMP '{START}' ORDER BY time LIMIT 24")
def _(t):
    return scans.time_range(t.points.select("time", "value"), "time", START).orderBy("time").limit(24)


@query("t5_top_ten", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


