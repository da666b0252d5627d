"""Reads of stored tables are bounded by their day folders; the rows are those of the unbounded form."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from seriesmill.operators.asof import asof_backward, asof_nearest
from seriesmill.plans import datasets, reports
from seriesmill.schemas import POWER_MEASURES
from seriesmill.sinks import tables
from seriesmill.sources import payloads, scans

DAY = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
START, END = "2024-01-21 06:00:00", "2024-01-24 06:00:00"
MEASURES = ["temperature_c", "wind_speed_ms", "humidity_percent", "pressure_hpa"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    hours = range(0, 30 * 24)
    power = [(DAY + h * HOUR, 100.0 + h % 24, 90.0, 5.0, 30.0, 1.0) for h in hours]
    prices = [(DAY + h * HOUR, float(h % 50), "FI", "imbalance") for h in hours]
    # Weather stops eleven days before the range and returns within it.
    weather = [(DAY + h * HOUR, "s", h / 10.0, 3.0, 60.0, 1000.0) for h in hours if h < 24 * 9 + 5 or h > 24 * 21]
    runs = [(DAY + h * HOUR, "consumption", 100.0, DAY) for h in hours]
    tables.store_power(spark.createDataFrame(power, "time timestamp, " + ", ".join(f"{c} double" for c in POWER_MEASURES)), f"{root}/power")
    tables.store_prices(spark.createDataFrame(prices, "time timestamp, price_eur_mwh double, area string, price_type string"), f"{root}/prices")
    tables.store_weather(spark.createDataFrame(weather, "time timestamp, station_id string, " + ", ".join(f"{c} double" for c in MEASURES)),
                         f"{root}/weather", station_id="s")
    forecast = spark.createDataFrame(weather, "forecast_time timestamp, station_id string, " + ", ".join(f"{c} double" for c in MEASURES))
    tables.store_weather_forecast(forecast, f"{root}/weather_forecasts", station_id="s", model="m", generated_at="2024-01-01 00:00:00")
    power_forecast = spark.createDataFrame(runs, "forecast_time timestamp, forecast_type string, value double, generated_at timestamp")
    tables.store_power_forecast(power_forecast, f"{root}/forecasts", generated_at="2024-01-01 00:00:00")
    return lambda name: tables.read_table(spark, f"{root}/{name}")


def scans_of(df):
    return re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\]", df._jdf.queryExecution().executedPlan().toString())


def assert_bounded(df, least):
    filters = scans_of(df)
    assert len(filters) >= least and all("date" in f for f in filters), filters


def test_training_dataset(stored):
    args = (stored("power"), stored("prices"), stored("weather"), START, END)
    assert_bounded(datasets.training_dataset(*args), 3)
    plain = [t.drop("date") for t in args[:3]]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(datasets.training_dataset(*args)) == rows(datasets.training_dataset(*plain, START, END))


def test_prediction_dataset(stored):
    names = ("weather_forecasts", "forecasts", "prices")
    found = datasets.prediction_dataset(*map(stored, names), START, END, lookback_hours=48)
    assert_bounded(found, 3)
    plain = datasets.prediction_dataset(*(stored(n).drop("date") for n in names), START, END, lookback_hours=48)
    assert found.columns == plain.columns and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))


def test_consumption_table_carries_the_row_before_the_range(stored):
    power, weather = stored("power"), stored("weather")
    found = datasets.joined_training_data(power, weather, START, END)
    assert_bounded(found, 2)
    inside = power.where(F.col("time").between(START, END)).select("time", *POWER_MEASURES)
    whole = asof_backward(inside, weather.select("time", *MEASURES), columns=MEASURES)
    want = sorted((r.time, r.temperature_c) for r in whole.collect())
    assert sorted((r.time, r.temperature) for r in found.collect()) == want
    assert want[0][1] == (24 * 9 + 4) / 10.0
    assert_bounded(datasets.consumption_training_table(power, weather, START, END), 2)


def test_newest_before(spark, stored):
    weather = stored("weather")
    take = lambda start: [tuple(r) for r in datasets.newest_before(weather, "time", ["temperature_c"], start).collect()]
    assert take("2024-01-15 00:00:00") == [(DAY + (24 * 9 + 4) * HOUR, (24 * 9 + 4) / 10.0)]
    assert take("2024-01-01 00:00:00") == [] and take("2024-01-01 00:30:00") == [(DAY, 0.0)]
    assert take("2060-01-01 00:00:00") == [(DAY + 719 * HOUR, 71.9)]
    twice = spark.createDataFrame([(DAY, 1.0), (DAY, 2.0), (None, 9.0)], "time timestamp, v double")
    assert [r.v for r in datasets.newest_before(twice, "time", ["v"], "2024-01-02 00:00:00").collect()] == [2.0]


def test_last_hours(stored):
    found = scans.last_hours(stored("power"), "time", 48, END)
    assert_bounded(found, 1)
    assert found.count() == 49


def test_recent_reports_read_their_period(spark):
    predictions = spark.createDataFrame(
        [], "timestamp timestamp, predicted_consumption_mw double, confidence_lower double, confidence_upper double,"
            " model_type string, model_version string, generated_at timestamp")
    actuals = spark.createDataFrame([], "time timestamp, consumption_mw double")
    plan = reports.recent_daily_accuracy(predictions, actuals, END, 10)._jdf.queryExecution().analyzed().toString()
    assert plan.count("2024-01-15 00:00:00") >= 2


def test_split_nearest_shuffles_its_rows_once(spark, tmp_path):
    path = tmp_path / "rows"
    spark.range(4000).selectExpr("timestamp_micros(1704067200000000 + id * 60000000) AS time", "id AS v").write.parquet(str(path))
    left, right = spark.read.parquet(str(path)), spark.read.parquet(str(path)).withColumnRenamed("v", "w")
    found = asof_nearest(left, right, columns=["w"], tolerance="1 minute", max_rows=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("+- == Initial Plan ==")[-1] if "Initial Plan" in plan else plan
    assert initial.count("FileScan parquet") == 3  # both sides, and the right one again for the ends of its pieces
    assert [r for r in found.collect() if r.v != r.w] == []


def test_payloads_are_parsed_once(spark):
    bodies = ['{"s": {"2024-01-01T00:00:00Z": {"Air temperature": {"value": 1.5, "units": "c"}}}}', None, "{", "{}", '{"s": {}}']
    rows = spark.createDataFrame([(i, "s", "S", b) for i, b in enumerate(bodies)], "id long, station string, name string, payload string")
    found = payloads.decode_weather(rows, "payload", "station", "name", order="id")
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") == 1
    assert [(r.station, r.temperature) for r in found.collect()] == [("s", 1.5)]
    rejected = payloads.rejected_weather(rows, "payload", "station", "name")
    assert {r.id: r.reason for r in rejected.collect()} == {
        1: payloads.MISSING, 2: payloads.UNREADABLE, 3: payloads.EMPTY, 4: payloads.OTHER_STATION}
    assert rejected.columns == [*rows.columns, "reason"]
    points = spark.createDataFrame(
        [(0, '{"data": [{"startTime": "2024-01-01T00:00:00Z", "value": 2.0}]}'), (1, None), (2, "{\"data\": ["), (3, '{"data": []}'), (4, "[]")],
        "id long, payload string")
    assert [r.id for r in payloads.decode_points(points, "payload").collect()] == [0]
    assert payloads.decode_points(points, "payload")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    reasons = {r.id: r.reason for r in payloads.rejected_points(points, "payload").collect()}
    assert reasons == {1: payloads.MISSING, 2: payloads.UNREADABLE, 3: payloads.EMPTY, 4: reasons[4]} and reasons[4] in (payloads.EMPTY, payloads.UNREADABLE)
