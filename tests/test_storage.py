"""Sinks, payloads, streaming state and the recursive forecast."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seriesmill.operators.history import add_target_history
from seriesmill.plans import recursive
from seriesmill.sinks import tables
from seriesmill.sources import payloads, scans
from seriesmill.streaming.carry import forward_fill_batches

T = dt.datetime
DAY = T(2024, 1, 1)


def power(spark, rows):
    return spark.createDataFrame(rows, "time timestamp, seq int, consumption_mw double")


def test_upsert_last_wins_and_keeps_other_columns(spark, tmp_path):
    path = str(tmp_path / "power")
    first = power(spark, [(DAY, 1, 1.0), (DAY, 2, 2.0), (DAY + dt.timedelta(days=1), 1, 9.0)])
    tables.store_power(first.withColumn("source", F.lit("old")), path, order=["seq"])
    tables.store_power(power(spark, [(DAY, 1, 5.0)]).withColumn("source", F.lit("new")), path, order=["seq"])
    rows = tables.read_table(spark, path).orderBy("time").collect()
    assert [(r.consumption_mw, r.source) for r in rows] == [(5.0, "old"), (9.0, "old")]
    again = power(spark, [(DAY, 1, 5.0)])
    tables.store_power(again, path, order=["seq"])
    assert tables.read_table(spark, path).count() == 2


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "prices")
    batch = spark.createDataFrame([(DAY, 10.0), (DAY, 20.0), (DAY + dt.timedelta(hours=1), 30.0)], "timestamp timestamp, price_eur_mwh double")
    assert tables.store_prices(batch, path) == (3, 2)
    assert tables.store_prices(batch.withColumn("price_eur_mwh", F.lit(7.0)), path) == (3, 0)
    assert {r.price_eur_mwh for r in tables.read_table(spark, path).collect()} == {10.0, 30.0}
    assert tables.store_prices(batch, path, area="SE") == (3, 2)


def test_cloud_cover_becomes_whole(spark, tmp_path):
    path = str(tmp_path / "weather")
    rows = [(DAY, 3.9), (DAY + dt.timedelta(hours=1), float("nan")), (DAY + dt.timedelta(hours=2), None)]
    tables.store_weather(spark.createDataFrame(rows, "timestamp timestamp, cloud_cover double"), path, station_id="s")
    stored = tables.read_table(spark, path).orderBy("time").collect()
    assert [r.cloud_cover for r in stored] == [3, None, None]


def test_retention_drops_whole_days(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    rows = spark.createDataFrame([(DAY + dt.timedelta(days=d), float(d)) for d in range(5)], "forecast_time timestamp, value double")
    tables.store_power_forecast(rows, path, generated_at="2024-01-01 00:00:00", forecast_type="wind")
    tables.apply_retention(spark, path, "power_forecasts", "2024-04-02 13:00:00")
    assert sorted(r.value for r in tables.read_table(spark, path).collect()) == [2.0, 3.0, 4.0]


def test_refresh_versions(spark, tmp_path):
    path = str(tmp_path / "view")
    for n in (3, 5, 7):
        assert tables.refresh(spark, path, lambda n=n: spark.range(n)).count() == n
    assert len(list((tmp_path / "view").glob("version=*"))) == 2
    assert tables.current_or_refresh(spark, path, lambda: spark.range(0)).count() == 7


def test_hot_day_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rows = spark.range(200_000).selectExpr(
            "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id/10) AS time", "rand(7) AS price_eur_mwh", "'FI' AS area", "string(id) AS price_type"
        ).repartition(8)
        tables.append(tables.conform(rows, "price_actuals"), path, "price_actuals")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "hot" / "date=2024-01-01").glob("*.parquet"))
    assert len(files) > 1
    assert tables.read_table(spark, path).count() == 200_000


def test_snapshot_and_scan_pushdown(spark, tmp_path):
    root = str(tmp_path / "snap")
    tables.snapshot(spark.range(5), root, "2024-01-01")
    tables.snapshot(spark.range(2), root, "2024-01-02")
    tables.snapshot(spark.range(3), root, "2024-01-02")
    assert scans.newest_snapshot(spark, root).count() == 3
    path = str(tmp_path / "power")
    tables.store_power(power(spark, [(DAY + dt.timedelta(days=d), 1, 1.0) for d in range(10)]), path)
    part = scans.power_actuals(tables.read_table(spark, path), "2024-01-04 00:00:00", "2024-01-05 00:00:00")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 2 and "date#" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(time" in plan


def test_payload_variants(spark):
    texts = [
        {"data": [{"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T01:00:00Z", "value": 1.5, "x": {}}]},
        {"data": [{"start_time": "2024-01-01T02:00:00+02:00", "end_time": "2024-01-01T03:00:00+02:00", "value": 2}]},
        {"data": []},
    ]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts], "payload string")
    rows = payloads.decode_points(df, "payload").orderBy("value").collect()
    assert [(r.start_time, r.value) for r in rows] == [(DAY, 1.5), (DAY, 2.0)]


def test_weather_station_choice(spark):
    def at(*pairs):
        return json.dumps({"2024-01-01T00:00:00Z": {name: {"Air temperature": {"value": v, "units": "C"}} for name, v in pairs}})

    cases = [
        ("exact", "Kumpula", at(("Other", 1.0), ("Kumpula", 2.0)), 2.0),
        ("only", "Kumpula", at(("Other", 3.0)), 3.0),
        ("case", "kumpula", at(("Other", 1.0), ("KUMPULA", 4.0)), 4.0),
        ("first", "Nowhere", at(("A", 5.0), ("B", 6.0)), 5.0),
        ("key", "x", json.dumps({"key": {"2024-01-01 00:00:00": {"Air temperature": {"value": 7.0}}}}), 7.0),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "station string, name string, payload string")
    got = {r.station: r.temperature for r in payloads.decode_weather(df, "payload", "station", "name").collect()}
    assert got == {c[0]: c[3] for c in cases}


def test_later_payload_wins(spark):
    rows = [("s", "n", i, json.dumps({"s": {"2024-01-01T00:00:00Z": {"Air temperature": {"value": float(i)}}}})) for i in (1, 3, 2)]
    df = spark.createDataFrame(rows, "station string, name string, i int, payload string")
    assert payloads.decode_weather(df, "payload", "station", "name", order="i").first().temperature == 3.0


def test_streaming_fill_is_repeatable(spark, tmp_path):
    fill = forward_fill_batches(str(tmp_path), ["v"], keys=["k"])
    one = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, None)], "k string, timestamp timestamp, v double")
    two = spark.createDataFrame([("a", DAY + dt.timedelta(hours=1), None), ("b", DAY + dt.timedelta(hours=1), 4.0)], "k string, timestamp timestamp, v double")
    fill(one, 0)
    fill(two, 1)
    fill(two, 1)
    rows = spark.read.parquet(str(tmp_path / "rows")).orderBy("k", "timestamp").collect()
    assert [(r.k, r.v) for r in rows] == [("a", 1.0), ("a", 1.0), ("b", None), ("b", 4.0)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_recursive_forecast_equals_step_by_step(spark, keys):
    """With a simple scorer, each step must equal the batch features over history + predictions."""
    rows = [("a", DAY + dt.timedelta(hours=h), None if h == 3 else float(h % 5 + h)) for h in range(12)]
    if keys:
        rows += [("b", DAY + dt.timedelta(hours=h), float(h)) for h in range(9, 12)]
    history = spark.createDataFrame(rows, "k string, timestamp timestamp, consumption_mw double").drop(*([] if keys else ["k"]))
    coming = spark.createDataFrame([(DAY + dt.timedelta(hours=12 + h), float(h)) for h in range(4)], "timestamp timestamp, temperature double")
    lags, windows = (1, 2, 6), (3, 6)

    def score(df):
        lag = F.coalesce(F.col("consumption_mw_lag_2h"), F.lit(0.0))
        return df.withColumn(
            "prediction", lag + F.col("consumption_mw_rolling_mean_3h") + F.coalesce(F.col("consumption_mw_rolling_std_6h"), F.lit(0.0)) + F.col("temperature")
        )

    got = recursive.recursive_forecast(history, coming, score, keys=keys, horizon=4, lags=lags, windows=windows, cut_every=2)
    got = {(r["k"] if keys else "a", r.timestamp): r.predicted_consumption_mw for r in got.collect()}
    known = [r if keys else ("a", *r[1:]) for r in rows]
    for h in range(4):
        at = DAY + dt.timedelta(hours=12 + h)
        series = sorted({r[0] for r in known})
        df = spark.createDataFrame(known + [(k, at, None) for k in series], "k string, timestamp timestamp, consumption_mw double")
        framed = add_target_history(df, keys=["k"], lags=lags, windows=windows).where(F.col("timestamp") == F.lit(at)).withColumn("temperature", F.lit(float(h)))
        for r in score(framed).collect():
            assert got[(r.k, at)] == pytest.approx(r.prediction, abs=1e-9)
            known.append((r.k, at, r.prediction))
