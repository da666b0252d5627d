"""Batch order, missing times, late stream rows, ties at the cut, reads that are bounded."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from seriesmill.functions.timecols import seconds
from seriesmill.operators import evaluation
from seriesmill.operators.joins import forward_fill
from seriesmill.plans import models
from seriesmill.plans.datasets import chronological_split
from seriesmill.sinks import tables
from seriesmill.sources import scans
from seriesmill.streaming.carry import forward_fill_batches

T = dt.datetime
DAY = T(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def test_last_row_of_a_batch_wins(spark, tmp_path):
    path = str(tmp_path / "weather")
    rows = spark.createDataFrame([(DAY, "s", 1, 9.0), (DAY, "s", 2, 1.0)], "time timestamp, station_id string, seq int, temperature_c double")
    tables.store_weather(rows, path, order=["seq"])
    assert [r.temperature_c for r in tables.read_table(spark, path).collect()] == [1.0]


def test_last_prediction_and_first_price_win(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([(DAY, 1, 9.0), (DAY, 2, 1.0)], "timestamp timestamp, seq int, predicted_consumption_mw double")
    tables.store_consumption_predictions(rows, path, model_type="m", generated_at="2024-01-01 00:00:00", order=["seq"])
    assert [r.predicted_consumption_mw for r in tables.read_table(spark, path).collect()] == [1.0]
    path = str(tmp_path / "prices")
    rows = spark.createDataFrame([(DAY, 1, 9.0), (DAY, 2, 1.0)], "time timestamp, seq int, price_eur_mwh double")
    assert tables.store_prices(rows, path, order=["seq"]) == (2, 1)
    assert [r.price_eur_mwh for r in tables.read_table(spark, path).collect()] == [9.0]


def test_rows_without_a_time_are_refused_with_a_warning(spark, tmp_path):
    path = str(tmp_path / "weather")
    rows = spark.createDataFrame([(None, "a", 1.0), (DAY, "a", 2.0)], "time timestamp, station_id string, temperature_c double")
    with pytest.warns(UserWarning, match="1 rows without a time"):
        tables.store_weather(rows, path)
    assert [r.temperature_c for r in tables.read_table(spark, path).collect()] == [2.0]


def test_newest_snapshot_reads_one_folder(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    for day, value in (("2024-01-02", 1), ("2024-01-10", 2), ("2023-12-31", 3)):
        tables.snapshot(spark.createDataFrame([(value,)], "v int"), root, day)
    newest = scans.newest_snapshot(spark, root)
    assert [r.v for r in newest.collect()] == [2]
    assert "PartitionFilters: [isnotnull" in newest._jdf.queryExecution().toString()


def fill(spark, root, batches, required=None):
    run = forward_fill_batches(root, ["a", "b"], keys=["site"], time="time", required=required)
    for i, rows in enumerate(batches):
        run(spark.createDataFrame(rows, "site string, time timestamp, a double, b double"), i)
    found = [tables.read_table(spark, f"{root}/{name}") for name in ("rows", "late")]
    return tuple([] if t is None else sorted((r.time, r.a, r.b) for r in t.collect()) for t in found)


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    rows, late = fill(spark, str(tmp_path / "fill"), [
        [("s", DAY + HOUR, 1.0, 5.0), ("s", DAY + 5 * HOUR, 2.0, 6.0)],
        [("s", DAY + 3 * HOUR, None, None), ("s", DAY + 6 * HOUR, None, 7.0)],
    ])
    assert rows == [(DAY + HOUR, 1.0, 5.0), (DAY + 5 * HOUR, 2.0, 6.0), (DAY + 6 * HOUR, 2.0, 7.0)]
    assert late == [(DAY + 3 * HOUR, None, None)]


def test_required_rows_still_count_for_the_state(spark, tmp_path):
    batches = [[("s", DAY, None, 5.0)], [("s", DAY + HOUR, 7.0, None)], [("s", DAY + 2 * HOUR, None, None)]]
    rows, _ = fill(spark, str(tmp_path / "fill"), batches, required="a")
    whole = spark.createDataFrame([r for b in batches for r in b], "site string, time timestamp, a double, b double")
    want = forward_fill(whole, ["a", "b"], time="time", keys=["site"], required="a").collect()
    assert rows == sorted((r.time, r.a, r.b) for r in want) == [(DAY + HOUR, 7.0, 5.0), (DAY + 2 * HOUR, 7.0, 5.0)]


def test_old_state_is_removed(spark, tmp_path):
    root = str(tmp_path / "fill")
    fill(spark, root, [[("s", DAY + i * HOUR, float(i), None)] for i in range(5)])
    assert sorted(p.name for p in (tmp_path / "fill" / "state").iterdir() if p.is_dir()) == ["batch=3", "batch=4"]


@pytest.mark.parametrize("size", [0.2, 0.5, 0.9])
def test_ties_and_missing_times_lie_in_one_part(spark, size):
    rows = [(DAY, i) for i in range(20)] + [(None, 100 + i) for i in range(5)] + [(DAY + HOUR, 50 + i) for i in range(7)]
    head, tail = chronological_split(spark.createDataFrame(rows, "time timestamp, v int").repartition(4), size)
    a, b = ([r.v for r in part.collect()] for part in (head, tail))
    assert len(a) == int(32 * (1 - size)) and sorted(a + b) == sorted(v for _, v in rows)
    assert all(v in a for v in range(100, 105)) or len(a) < 5


def test_weeks(spark):
    assert seconds("1 week") == 7 * 86400


def test_accuracy_reads_only_the_hours_it_compares(spark):
    frame = spark.createDataFrame([], "time timestamp, consumption_mw double")
    predictions = spark.createDataFrame(
        [], "timestamp timestamp, predicted_consumption_mw double, confidence_lower double, confidence_upper double,"
            " model_type string, model_version string, generated_at timestamp")
    plan = evaluation.model_comparison(predictions, frame, "2024-01-25 12:00:00")._jdf.queryExecution().analyzed().toString()
    assert re.search(r"time#\d+ >= date_trunc\(hour", plan)


def test_retraining_takes_the_last_days(spark, monkeypatch):
    rows = spark.createDataFrame([(DAY + i * 6 * HOUR, float(i)) for i in range(800)], "time timestamp, price_eur_mwh double")
    seen = []
    monkeypatch.setattr(models, "train_price", lambda df, **_: seen.append(df.agg(F.min("time"), F.count("*")).first()))
    models.retrain_price(rows)
    last = DAY + 799 * 6 * HOUR
    assert tuple(seen[0]) == (last - dt.timedelta(days=60), 241)
    with pytest.raises(models.TooFewRows):
        models.retrain_price(rows, days=10)
