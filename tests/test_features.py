"""Asserted values of features, calendar, rules and datasets."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import calendar, supply, weather
from seriesmill.operators import history, joins, latest, resample, rules
from seriesmill.plans import datasets


def ntz(spark, rows, columns):
    df = spark.createDataFrame(rows, columns)
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


T = dt.datetime


def test_time_features(spark):
    df = ntz(spark, [(T(2024, 1, 1, 12), 8500.0), (T(2024, 1, 6, 18), 8600.0), (T(2024, 1, 5, 1), 1.0)], "timestamp timestamp, consumption_mw double")
    rows = calendar.add_time_features(df).orderBy("timestamp").collect()
    assert rows[0].hour_of_day == 12 and [r.is_weekend for r in rows] == [False, True, True]
    price = df.select("timestamp").withColumns(calendar.clock_features("timestamp")).orderBy("timestamp").collect()
    assert [r.is_weekend for r in price] == [False, False, True]


def test_align_to_hourly(spark):
    df = ntz(spark, [(T(2024, 1, 1, 12, m), v) for m, v in ((0, 8500.0), (15, 8520.0), (30, 8510.0), (45, 8530.0))], "timestamp timestamp, consumption_mw double")
    rows = resample.align_to_hourly(df).collect()
    assert len(rows) == 1 and rows[0].consumption_mw == pytest.approx(8515.0)


def test_holidays(spark):
    days = {r.date for r in calendar.holidays(spark).collect()}
    for known in ("2024-01-01", "2024-01-06", "2024-03-29", "2024-03-31", "2024-04-01", "2024-05-01", "2024-05-09",
                  "2024-05-19", "2024-06-21", "2024-06-22", "2024-11-02", "2024-12-06", "2024-12-24", "2024-12-25",
                  "2024-12-26", "2025-04-20", "2030-04-21"):
        assert dt.date.fromisoformat(known) in days, known
    assert sum(d.year == 2024 for d in days) == 15


def test_holidays_of_any_year(spark):
    """1950 to 2100 against Python dates: every day has its flags, over the ends of years too."""
    def easter(y):
        a, b, c = y % 19, y // 100, y % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        n = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
        return dt.date(y, n // 31, n % 31 + 1)

    known, day = set(), dt.timedelta(days=1)
    for y in range(1949, 2102):
        known |= {dt.date(y, m, d) for m, d in ((1, 1), (1, 6), (5, 1), (12, 6), (12, 24), (12, 25), (12, 26))}
        known |= {easter(y) + n * day for n in (-2, 0, 1, 39, 49)}
        for start, number in ((dt.date(y, 6, 19), 5), (dt.date(y, 6, 20), 6), (dt.date(y, 10, 31), 6)):
            known.add(next(start + n * day for n in range(7) if (start + n * day).isoweekday() == number))
    assert easter(2024) == dt.date(2024, 3, 31) and easter(1961) == dt.date(1961, 4, 2)
    frame = spark.sql("SELECT explode(sequence(DATE'1950-01-01', DATE'2100-12-31')) AS timestamp")
    for r in calendar.add_holiday_features(frame).collect():
        d, n = r.timestamp, r.timestamp.isoweekday()
        bridge = (n == 5 and d - day in known) or (n == 1 and d + day in known)
        assert (r.is_holiday, r.is_holiday_eve, r.is_bridge_day) == (d in known, d + day in known, bridge), d
    empty = calendar.add_holiday_features(spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS timestamp")).first()
    assert not (empty.is_holiday or empty.is_holiday_eve or empty.is_bridge_day)


def test_holiday_flags(spark):
    times = [T(2024, 5, 9, 5), T(2024, 5, 10, 5), T(2024, 5, 8, 23), T(2024, 12, 23, 1), T(2024, 12, 31, 1), T(2024, 7, 9)]
    rows = calendar.add_holiday_features(ntz(spark, [(t,) for t in times], "timestamp timestamp")).collect()
    flags = {r.timestamp: (r.is_holiday, r.is_holiday_eve, r.is_bridge_day) for r in rows}
    assert flags[times[0]] == (True, False, False)
    assert flags[times[1]] == (False, False, True)  # Friday after a Thursday holiday
    assert flags[times[2]] == (False, True, False)
    assert flags[times[3]] == (False, True, True)  # Monday before Tuesday, 24 December
    assert flags[times[4]] == (False, True, False)  # across the year
    assert flags[times[5]] == (False, False, False)


def test_weather_edges(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS temperature, -1.0D AS wind_speed UNION ALL SELECT -5.0D, 3.0D")
    rows = weather.add_weather_interactions(df).collect()
    assert rows[0].heating_degree_days == 0 and rows[1].heating_degree_days == 23
    chill = spark.sql("SELECT -5.0D AS temperature, -1.0D AS wind_speed")
    assert math.isnan(weather.add_weather_interactions(chill).first().wind_chill)
    assert "wind_chill" not in weather.add_weather_interactions(df.drop("wind_speed")).columns


def test_supply_keeps_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS consumption_mw, 5.0D AS production_mw UNION ALL SELECT 0.5D, 5.0D")
    rows = supply.add_supply_features(df).collect()
    assert rows[0].supply_demand_ratio is None and rows[1].supply_demand_ratio == 5.0


def test_forward_fill_drops_leading(spark):
    rows = [(T(2024, 1, 1, h), c, p) for h, c, p in ((0, None, 1.0), (1, 5.0, None), (2, None, None), (3, 7.0, 2.0))]
    df = ntz(spark, rows, "timestamp timestamp, consumption_mw double, production_mw double")
    out = joins.forward_fill(df, ["consumption_mw", "production_mw"]).orderBy("timestamp").collect()
    assert [(r.consumption_mw, r.production_mw) for r in out] == [(5.0, 1.0), (5.0, 1.0), (7.0, 2.0)]


def test_merge_frames(spark):
    a = ntz(spark, [(T(2024, 1, 1), 1.0)], "timestamp timestamp, value double")
    b = ntz(spark, [(T(2024, 1, 2), 2.0)], "timestamp timestamp, value double")
    rows = joins.merge_frames({"wind": a, "nuclear": b}).orderBy("timestamp").collect()
    assert [(r.wind_mw, r.nuclear_mw) for r in rows] == [(1.0, None), (None, 2.0)]


def test_empty_precipitation_sums_to_zero(spark):
    df = ntz(spark, [(T(2024, 1, 1, 0, 5), "s", 1.0, None)], "time timestamp, station_id string, temperature_c double, precipitation_mm double")
    assert resample.resample_weather(df).first().precipitation_mm == 0.0


def test_one_row_history(spark):
    df = ntz(spark, [(T(2024, 1, 1), 5.0)], "timestamp timestamp, consumption_mw double")
    row = history.add_target_history(df).first()
    assert row["consumption_mw_lag_1h"] is None and row["consumption_mw_rolling_std_6h"] is None
    assert row["consumption_mw_rolling_mean_6h"] == 5.0


def test_empty_frames(spark):
    df = ntz(spark, [], "timestamp timestamp, consumption_mw double, temperature double")
    assert datasets.consumption_features(df).count() == 0
    assert joins.forward_fill(df, ["consumption_mw"]).count() == 0
    assert resample.align_to_hourly(df).count() == 0


def test_latest_row_with_nulls(spark):
    df = ntz(spark, [("k", T(2024, 1, 1), 1.0), ("k", T(2024, 1, 2), None)], "k string, run timestamp, v double")
    assert latest.latest_per_key(df, ["k"], ["run"]).first().v is None
    assert latest.last_known(df, "run", ["v"], ["k"]).first().v is None


def test_rules(spark):
    df = spark.sql("SELECT 60.0D AS temperature_c, '' AS station_id UNION ALL SELECT CAST(NULL AS DOUBLE), 's'")
    assert rules.rejected_rows(df).first().reasons == ["temperature_c above 50", "station_id empty"]
    assert rules.valid_rows(df).count() == 1


def test_prediction_dataset(spark):
    start = T(2024, 1, 1, 12)
    hours = [start, start + dt.timedelta(hours=1)]
    weather_rows = ntz(
        spark, [(h, "101004", t, w, hu, p, c, start) for h, t, w, hu, p, c in zip(hours, (-5.0, -4.0), (3.0, 4.5), (75.0, 80.0), (1005.0, 1003.0), (5.0, 6.0))],
        "forecast_time timestamp, station_id string, temperature_c double, wind_speed_ms double, humidity_percent double, pressure_hpa double, cloud_cover double, generated_at timestamp",
    )
    power_rows = ntz(
        spark, [(h, k, v, start) for h in hours for k, v in (("consumption", 10000.0), ("production", 9500.0), ("wind", 1200.0))],
        "forecast_time timestamp, forecast_type string, value double, generated_at timestamp",
    )
    prices = ntz(
        spark, [(start - dt.timedelta(hours=h), v, "FI") for h, v in ((1, 50.0), (2, 48.0), (25, 60.0), (0, 99.0))],
        "time timestamp, price_eur_mwh double, area string",
    )
    args = (weather_rows, power_rows, prices, start.isoformat(sep=" "), hours[1].isoformat(sep=" "))
    rows = datasets.prediction_dataset(*args).orderBy("forecast_time").collect()
    assert [r.price_lag_1h for r in rows] == [50.0, None]
    assert rows[0].temperature == -5.0 and rows[0].consumption_forecast_mw == 10000.0 and rows[0].is_shortage
    literal = datasets.prediction_dataset(*args, literal_history=True).orderBy("forecast_time").first()
    assert literal.price_lag_1h == 99.0


def test_training_dataset_needs_rows(spark):
    power = ntz(spark, [(T(2024, 1, 1), *[1.0] * 5)], "time timestamp, consumption_mw double, production_mw double, wind_mw double, nuclear_mw double, net_import_mw double")
    prices = ntz(spark, [], "time timestamp, price_eur_mwh double, area string")
    with pytest.raises(ValueError, match="No price data"):
        datasets.training_dataset(power, prices, None, "2024-01-01", "2024-01-02")


def test_sparse_rows_count_nan_as_value(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS a, 1 AS b, 1 AS c, 1 AS d, 1 AS e UNION ALL SELECT NULL, NULL, 1, 1, 1")
    assert datasets.drop_sparse_rows(df).count() == 1
