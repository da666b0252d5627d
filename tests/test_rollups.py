"""Rollup tables of streams: no growth by batch, repeated batches, repairs, state by hash folder."""

import datetime as dt

import pytest

from seriesmill.operators.joins import forward_fill
from seriesmill.operators.resample import power_hourly
from seriesmill.sinks import tables
from seriesmill.streaming import rollups
from seriesmill.streaming.carry import forward_fill_batches, state_folders
from seriesmill.streaming.repairs import RepairableRollup

DAY = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
RAW = "time timestamp, consumption_mw double, production_mw double, wind_mw double, nuclear_mw double, net_import_mw double"


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def changed(spark, rows):
    return spark.createDataFrame(rows, "hour timestamp, site string, total double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_folders_do_not_grow_with_batches(spark, tmp_path):
    path = tmp_path / "rollup"
    for i in range(6):
        batch = changed(spark, [(DAY + HOUR, "a", float(i)), (DAY + 30 * HOUR, "b", 1.0), (None, "a", 9.0)])
        rollups.merge_batch(batch, i, str(path), ["hour", "site"], "hour")
    assert rows_of(rollups.rollup(spark, str(path))) == [(DAY + HOUR, "a", 5.0), (DAY + 30 * HOUR, "b", 1.0)]
    assert sorted(p.name for p in path.iterdir() if p.is_dir()) == ["date=2024-01-01", "date=2024-01-02"]
    assert len(files_of(path)) == 2


def test_repeated_and_older_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "rollup")
    batches = [[(DAY, "a", 1.0), (DAY, None, 2.0)], [(DAY, "a", 3.0)], [(DAY + 30 * HOUR, "a", 4.0)]]
    for i, rows in enumerate(batches):
        rollups.merge_batch(changed(spark, rows), i, path, ["hour", "site"], "hour")
    want = rows_of(rollups.rollup(spark, path))
    assert want == sorted([(DAY, "a", 3.0), (DAY, None, 2.0), (DAY + 30 * HOUR, "a", 4.0)], key=repr)
    for i in (2, 1, 0):
        rollups.merge_batch(changed(spark, batches[i]), i, path, ["hour", "site"], "hour")
        assert rows_of(rollups.rollup(spark, path)) == want
    rollups.merge_batch(changed(spark, []), 3, path, ["hour", "site"], "hour")
    assert rows_of(rollups.rollup(spark, path)) == want


def test_days_that_a_batch_leaves_alone_are_not_rewritten(spark, tmp_path):
    path = tmp_path / "rollup"
    rollups.merge_batch(changed(spark, [(DAY, "a", 1.0), (DAY + 30 * HOUR, "a", 2.0)]), 0, str(path), ["hour", "site"], "hour")
    before = {f for f in files_of(path) if "2024-01-02" in f}
    rollups.merge_batch(changed(spark, [(DAY, "b", 1.0)]), 1, str(path), ["hour", "site"], "hour")
    assert before <= set(files_of(path))


@pytest.fixture
def hourly(spark, tmp_path):
    raw = str(tmp_path / "raw")
    return RepairableRollup(
        spark, str(tmp_path / "rollup"), store=lambda rows: tables.store_power(rows, raw), raw=lambda: tables.read_table(spark, raw),
        compute=power_hourly, time="time", bucket="hour", every="1 hour", lateness="1 day")


def power(spark, *rows):
    return spark.createDataFrame([(DAY + h * HOUR if h is not None else None, v, None, None, None, None) for h, v in rows], RAW)


def sums(rows):
    return {r.hour: (r.sample_count, r.max_consumption_mw) for r in rows.collect()}


@pytest.mark.filterwarnings("ignore:power_actuals")
def test_late_rows_are_stored_logged_and_repaired(spark, hourly):
    batches = [power(spark, (0, 1.0), (0.5, 2.0), (40, 5.0)), power(spark, (0.25, 9.0), (20.5, 7.0), (41, 6.0), (None, 1.0)),
               power(spark, (0.5, 8.0), (41, 6.5))]
    for i, batch in enumerate(batches):
        hourly.batch(batch, i)
        hourly.batch(batch, i)  # a repeated batch
    # 20:00 of the first day ends after the watermark (16:00), 00:00 before it.
    current = sums(rollups.rollup(spark, hourly.path))
    assert current == {DAY: (2, 2.0), DAY + 20 * HOUR: (1, 7.0), DAY + 40 * HOUR: (1, 5.0), DAY + 41 * HOUR: (1, 6.5)}
    assert [r.bucket for r in hourly.stale().collect()] == [DAY]
    assert hourly.repair() == 1
    want = sums(power_hourly(hourly.raw()))
    assert sums(rollups.rollup(spark, hourly.path)) == want and want[DAY] == (3, 9.0)
    assert hourly.repair() == 0
    hourly.batch(power(spark, (42, 1.0)), 3)
    assert sums(rollups.rollup(spark, hourly.path)) == sums(power_hourly(hourly.raw()))


def test_a_repair_reads_the_days_of_the_log_only(spark, hourly):
    from seriesmill.streaming.repairs import of_buckets

    hourly.batch(power(spark, (0, 1.0), (40, 5.0)), 0)
    buckets = spark.createDataFrame([(DAY,)], "bucket timestamp")
    plan = of_buckets(hourly.raw(), buckets, "time", "1 hour")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [(date" in plan


def fill_rows(spark, rows):
    return spark.createDataFrame(rows, "site string, time timestamp, a double")


def test_only_touched_folders_of_the_state_are_written(spark, tmp_path):
    root = str(tmp_path / "fill")
    run = forward_fill_batches(root, ["a"], keys=["site"], time="time", parts=16)
    sites = [f"s{i}" for i in range(20)]
    run(fill_rows(spark, [(s, DAY, float(i)) for i, s in enumerate(sites)]), 0)
    parts = state_folders(spark, f"{root}/state")
    run(fill_rows(spark, [("s3", DAY + HOUR, None)]), 1)
    after = state_folders(spark, f"{root}/state")
    assert sum(b == [0, 1] for b in after.values()) == 1 and sum(b == [0] for b in after.values()) == len(parts) - 1
    run(fill_rows(spark, [(s, DAY + 2 * HOUR, None) for s in sites]), 2)
    filled = {(r.site, r.time): r.a for r in spark.read.parquet(f"{root}/rows").collect()}
    assert all(filled[s, DAY + 2 * HOUR] == float(i) for i, s in enumerate(sites)) and filled["s3", DAY + HOUR] == 3.0


def test_repeated_fill_batch_is_the_same(spark, tmp_path):
    root = str(tmp_path / "fill")
    run = forward_fill_batches(root, ["a"], keys=["site"], time="time")
    batches = [[("x", DAY, 1.0), (None, DAY, 4.0)], [("x", DAY + HOUR, None), ("y", DAY, None)], [("x", DAY + 2 * HOUR, None), (None, DAY + HOUR, None)]]
    for i, rows in enumerate(batches):
        run(fill_rows(spark, rows), i)
        run(fill_rows(spark, rows), i)
    whole = forward_fill(fill_rows(spark, sum(batches, [])), ["a"], time="time", keys=["site"], required=None)
    assert rows_of(spark.read.parquet(f"{root}/rows").select("site", "time", "a")) == rows_of(whole.select("site", "time", "a"))
