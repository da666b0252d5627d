"""Rollups over a raw table that a stream writes, with a log of stale buckets.

Every micro-batch first stores its rows in the raw table.  The buckets that it touches are then
computed anew from that table, so a row that arrives twice or with another value counts once.  Only
buckets that end after the watermark (the newest time of all earlier batches less the lateness)
are refreshed at once.  Older ones keep their rollup row, and go into a log of stale buckets;
`repair` computes just the logged buckets and empties the log.

Folders of `root`: `rollup` (partitioned by day), `stale` (by batch), `progress` (newest time seen).
All steps are repeatable: a batch that runs twice leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.functions.timecols import floor_time, seconds, shift_time
from seriesmill.session import bounded_broadcast, cut, folder_values
from seriesmill.sinks.tables import DATE, drop_folders, read_table
from seriesmill.streaming.rollups import LISTED_DAYS, merge_batch

BATCH = "batch"


def of_buckets(raw: DataFrame, buckets: DataFrame, time: str, every: str) -> DataFrame:
    """Rows of the raw table in the given buckets (column `bucket`); other day folders are not read."""
    if DATE in raw.columns:
        days = [r[0] for r in buckets.select(F.to_date("bucket")).distinct().limit(LISTED_DAYS + 1).collect()]
        if len(days) <= LISTED_DAYS:
            raw = raw.where(F.col(DATE).isin(days))
    wanted = bounded_broadcast(buckets.select(F.col("bucket").alias("__bucket")))
    return raw.join(wanted, floor_time(raw, time, every) == F.col("__bucket"), "left_semi")


class RepairableRollup:
    """A rollup of width `every` at `<root>/rollup`.

    `store(batch)` writes the raw table, `raw()` reads it, `compute(rows)` makes the rollup rows with the
    start of their bucket in the column `bucket`; `keys` are further keys of the rollup.
    """

    def __init__(
        self, spark: SparkSession, root: str, *, store: Callable[[DataFrame], None], raw: Callable[[], DataFrame],
        compute: Callable[[DataFrame], DataFrame], time: str, bucket: str, every: str, lateness: str, keys: tuple[str, ...] = (),
    ):
        self.spark, self.root, self.store, self.raw, self.compute = spark, root, store, raw, compute
        self.time, self.bucket, self.every, self.lateness, self.keys = time, bucket, every, lateness, keys
        self.path, self.stale_path, self.progress_path = (f"{root}/{n}" for n in ("rollup", "stale", "progress"))

    def _batches(self, path: str) -> list[int]:
        return sorted(map(int, folder_values(self.spark, path, BATCH)))

    def _write(self, df: DataFrame, path: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    def _merge(self, buckets: DataFrame, batch_id: int) -> None:
        rows = of_buckets(self.raw(), buckets, self.time, self.every)
        merge_batch(self.compute(rows), batch_id, self.path, [self.bucket, *self.keys], self.bucket)

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`.  Rows without a time are left to `store`."""
        rows = cut(rows)
        self.store(rows)
        seen = rows.where(F.col(self.time).isNotNull())
        # One row per bucket of the batch.
        touched = cut(seen.groupBy(floor_time(seen, self.time, self.every).alias("bucket")).agg(F.max(self.time).alias("newest")))
        earlier = [b for b in self._batches(self.progress_path) if b < batch_id]
        newest = touched.select("newest")
        refreshed, stale = touched, None
        if earlier:
            before = self.spark.read.schema(newest.schema).parquet(f"{self.progress_path}/{BATCH}={earlier[-1]}")
            watermark = shift_time(F.lit(before.first()[0]).cast(newest.schema["newest"].dataType), -seconds(self.lateness) / 3600)
            on_time = shift_time(F.col("bucket"), seconds(self.every) / 3600) > watermark
            refreshed, stale = touched.where(F.coalesce(on_time, F.lit(True))), touched.where(~on_time)
            newest = newest.unionByName(before)
        self._merge(refreshed, batch_id)
        if stale is not None:
            self._write(stale.select("bucket"), self.stale_path, batch_id)
        self._write(newest.agg(F.max("newest").alias("newest")), self.progress_path, batch_id)
        # A repeated batch needs the progress before its own.
        for b in earlier[:-1]:
            drop_folders(self.spark, self.progress_path, BATCH, lambda n, b=b: int(n) == b)

    def stale(self) -> DataFrame | None:
        """The logged buckets, or None if there is no log."""
        logged = read_table(self.spark, self.stale_path)
        return None if logged is None else logged.select("bucket").distinct()

    def repair(self) -> int:
        """Computes the stale buckets from the raw table; returns how many there were.  Runs between
        micro-batches.  If it fails it can be run again: the log is emptied last."""
        logged, done = self.stale(), self._batches(self.stale_path)
        if logged is None:
            return 0
        logged = cut(logged)
        count = logged.count()
        if count:
            self._merge(logged, self._batches(self.progress_path)[-1])
        drop_folders(self.spark, self.stale_path, BATCH, lambda n: int(n) in done)
        return count
