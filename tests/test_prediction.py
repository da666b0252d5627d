"""Price history of forecast rows, against plain loops."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import history
from seriesmill.registered import QUERIES
from seriesmill.registered.features import FUTURE_START

DAY = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def test_features_of_all_stations_and_areas(spark, tmp_path):
    """f14: every station, hour and area once, with the last price of its own series."""
    first, kinds, draw = dt.datetime.fromisoformat(FUTURE_START), ["view", "click", "purchase", "signup", "error"], random.Random(3)
    times = [first - dt.timedelta(days=40) + 2 * HOUR * k for k in range(480)] + [first + k * HOUR / 12 for k in range(120)]
    rows = [(i, t, draw.randrange(24), kinds[i % 5], float(draw.randrange(200)), "{}") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for _, t, user, _, value, _ in rows:
        if t < first:
            last[f"s{user % 3}", "SE" if user % 4 == 0 else "FI"] = value - 50
    hours = {(f"s{user % 3}", t.replace(minute=0)) for _, t, user, *_ in rows if t >= first}
    got = QUERIES["f14_prediction_features"](spark, str(tmp_path)).collect()
    assert sorted((r.station_id, r.forecast_time, r.area) for r in got) == sorted((s, t, a) for s, t in hours for a in ("FI", "SE"))
    begin = {s: min(t for x, t in hours if x == s) for s, _ in hours}
    heads = [r for r in got if r.forecast_time == begin[r.station_id]]
    assert len(heads) == 6 and all(r.price_lag_1h == pytest.approx(last[r.station_id, r.area], abs=1e-6) for r in heads)


def plain(known, times, lags, windows):
    """Features of the future rows at `times` (None first) of one series."""
    place = lambda row: (row[0] is not None, row[0] or DAY, row[2])
    series = sorted([(t, max((p for u, p in known if u == t and p is not None), default=None), False) for t in {t for t, _ in known}]
                    + [(t, None, True) for t in times], key=place)
    prices, out = [p for _, p, _ in series], []
    for i, (t, _, future) in enumerate(series):
        if future:
            row = [prices[i - n] if i >= n else None for n in lags]
            for n in windows:
                frame = [p for p in prices[max(0, i - n + 1):i + 1] if p is not None]
                row += [statistics.fmean(frame), min(frame), max(frame)] if len(frame) == n else [None] * 3
            out.append((t, row))
    return out


@pytest.mark.parametrize("max_rows", [None, 7])
def test_history_of_future_rows(spark, max_rows):
    """Series with gaps, without a history, without future rows, with rows without a time, with history after
    the first future row."""
    draw = random.Random(9)
    known, future = [], []
    for key, n, at in (("a", 60, [60, 61, 64]), ("b", 40, [-1, 10, 25, 26, 44]), (None, 30, [31, None]), ("c", 0, [3, 4]), ("d", 20, []), ("e", 3, [9])):
        times = [DAY + k * HOUR for k in range(n) if draw.random() < 0.8] + ([None] if key in ("a", "b", None) else [])
        known += [(key, t, draw.choice([None, *range(50)])) for t in times for _ in range(2)]
        future += [(key, None if k is None else DAY + k * HOUR + HOUR / 2 * (k < 20)) for k in at]
    known = [(k, t, None if p is None else float(p)) for k, t, p in known]
    lags, windows = (1, 2, 5), (2, 4)
    got = history.add_price_history_to_future(
        spark.createDataFrame(future, "area string, forecast_time timestamp"),
        spark.createDataFrame(known, "area string, time timestamp, price_eur_mwh double"),
        keys=["area"], lags=lags, windows=windows, max_rows=max_rows).collect()
    want = {(k, t): row for k in {k for k, _ in future} for t, row in plain(
        [(t, p) for x, t, p in known if x == k], [t for x, t in future if x == k], lags, windows)}
    assert len(got) == len(want) == len(future)
    for r in got:
        values = [r[f"price_lag_{n}h"] for n in lags] + [r[f"price_rolling_{m}_{n}h"] for n in windows for m in ("mean", "min", "max")]
        assert values == pytest.approx(want[r.area, r.forecast_time]), (r.area, r.forecast_time)


def test_frames_leave_out_history_that_no_row_reaches(spark, monkeypatch):
    """Of a long history only the rows of the longest frame go into the one window, with and without keys."""
    taken, whole = [], history.with_frames
    monkeypatch.setattr(history, "with_frames", lambda df, *a, **b: (taken.append(df.count()), whole(df, *a, **b))[1])
    known = spark.range(5000).select(
        F.col("id").cast("timestamp").alias("time"), F.lit("x").alias("area"), F.col("id").cast("double").alias("price_eur_mwh"))
    future = spark.range(5000, 5003).select(F.col("id").cast("timestamp").alias("forecast_time"), F.lit("x").alias("area"))
    for keys in ([], ["area"]):
        got = history.add_price_history_to_future(future, known, keys=keys).orderBy("forecast_time").first()
        assert got.price_lag_1h == 4999 and got.price_lag_168h == 4832 and got.price_rolling_max_6h is None
    assert taken == [171, 171]
