"""Structured Streaming forms of the incremental rollups, upserts and latest-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seriesmill.functions.sketches import BUCKET, COUNT, bucket
from seriesmill.functions.states import stats_state
from seriesmill.functions.timecols import moment, shift_time
from seriesmill.operators.latest import latest_per_key
from seriesmill.session import cut
from seriesmill.sinks.tables import DATE, read_table, write_days

# How far back a rollup is refreshed, and the part of the end that is left out.
POWER_LATENESS, PRICE_LATENESS = "3 days", "7 days"
END_OFFSET_HOURS = 1
# Days of a micro-batch that are listed by name; more are joined.
LISTED_DAYS = 1_000


def read_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, pattern: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern).parquet(path)
    )


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a TIMESTAMP, stored times may have no zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def complete_part(df: DataFrame, time: str, as_of: str) -> DataFrame:
    """Leaves out the hour that is still filling."""
    return df.where(F.col(time) < shift_time(moment(df, time, as_of), -END_OFFSET_HOURS))


def power_hourly_stream(df: DataFrame, lateness: str = POWER_LATENESS) -> DataFrame:
    """Hourly consumption rollup; rows later than the watermark no longer change it."""
    return (
        event_time(df, "time")
        .withWatermark("time", lateness)
        .groupBy(F.window("time", "1 hour").alias("w"))
        .agg(
            stats_state(F.col("consumption_mw")).alias("consumption_stats"),
            F.max("consumption_mw").alias("max_consumption_mw"),
            F.min("consumption_mw").alias("min_consumption_mw"),
            F.avg("production_mw").alias("avg_production_mw"),
            F.avg("wind_mw").alias("avg_wind_mw"),
            F.avg("nuclear_mw").alias("avg_nuclear_mw"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .withColumn("hour", F.col("w.start"))
        .drop("w")
    )


def prices_daily_stream(df: DataFrame, lateness: str = PRICE_LATENESS) -> DataFrame:
    """The long form of the daily rollup (`resample.prices_daily_counts`): one group per day, area and value
    bucket.  `resample.prices_daily_state` turns the stored rows into the rollup with its sketch."""
    return (
        event_time(df, "time")
        .withWatermark("time", lateness)
        .groupBy(F.window("time", "1 day").alias("w"), "area", bucket(F.col("price_eur_mwh")).alias(BUCKET))
        .agg(
            F.count("price_eur_mwh").alias(COUNT),
            stats_state(F.col("price_eur_mwh")).alias("price_stats"),
            F.max("price_eur_mwh").alias("max_price"),
            F.min("price_eur_mwh").alias("min_price"),
        )
        .withColumn("day", F.col("w.start"))
        .drop("w")
    )


def without_repeats(df: DataFrame, time: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """Overlapping re-reads: one row per key while its time is within the watermark."""
    return event_time(df, time).withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def latest_run_stream(
    df: DataFrame, keys: Sequence[str], run: str, columns: Sequence[str], *, time: str, lateness: str
) -> DataFrame:
    """Newest run per key as runs arrive (update mode).  `time` is one of the keys; a key is
    forgotten when it is older than the newest time by more than `lateness`."""
    df = event_time(df, time).withWatermark(time, lateness)
    return df.groupBy(*keys).agg(F.max_by(F.struct(run, *columns), F.col(run)).alias("__r")).select(*keys, "__r.*")


def upsert_stream(df: DataFrame, checkpoint: str, store, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch goes to `store(batch)`; the upserts are idempotent, so a batch that is
    repeated after a failure changes nothing."""
    writer = df.writeStream.foreachBatch(lambda batch, _: store(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows only, each written once."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )


VERSION = "batch"


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], time: str) -> None:
    """Merges the rows of a micro-batch into the rollup stored at `path`, partitioned by the day of `time`.

    Only the days of the batch are read and replaced.  The row of the highest batch number holds, of
    equal ones the new row, so a batch that is repeated, in full or after half of its days were
    written, changes nothing.  Rows without a time are not stored.
    """
    rows = cut(batch.where(F.col(time).isNotNull()).withColumns({VERSION: F.lit(batch_id).cast("long"), DATE: F.to_date(time)}))
    days = [r[DATE] for r in rows.select(DATE).distinct().limit(LISTED_DAYS + 1).collect()]
    if not days:
        return
    old = read_table(batch.sparkSession, path)
    if old is not None:
        touched = (
            old.where(F.col(DATE).isin(days)) if len(days) <= LISTED_DAYS
            else old.join(rows.select(DATE).distinct(), DATE, "left_semi"))
        both = touched.select(*rows.columns).withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        rows = latest_per_key(both, [*keys, DATE], [VERSION, "__new"]).drop("__new")
    write_days(rows, path, "append" if old is None else "overwrite", keys)


def update_stream(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str) -> StreamingQuery:
    """The changed groups of every micro-batch are merged into the rollup at `path`."""
    return (
        df.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path, keys, time))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def rollup(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a rollup: one per key."""
    return spark.read.parquet(path).drop(VERSION, DATE)
