"""Exact deduplication as a stateful stream.

Rows arrive as (digest, stable id, content locator).  A streaming aggregation with a RocksDB
state store keeps one entry per digest for ever (no watermark, no expiry): the row to keep, its
locator and the number of rows seen.  Partial aggregation in every task leaves one row per digest
and task before the shuffle, so a text that fills a third of the table is no hot key.  The table is
streamed in several micro-batches, so later rows hit entries that earlier batches left in the state.
Every micro-batch compares the full bytes of the digests that it hit for the first time, over all rows of
the table that have them; texts that share a digest but differ are told apart by the text itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmill.llm.common import FILE, ROW, restored, set_aside, stored, with_row_keys
from seriesmill.session import bounded_broadcast, folder_values, scratch_path

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One bound for all state stores of an executor; beyond it RocksDB works from disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Stores of a stream that has ended are closed soon, not after a minute.
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    # Many small stores: no space is set aside ahead of use.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


# Micro-batches that a table is streamed in, whatever its size (its files are not divided).
BATCHES = 4


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def arrivals(keyed: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document of a table with row keys; only `text` is wide."""
    rows = keyed.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), FILE, ROW)
    return rows.withColumn("digest", digest(F.col("text")))


def bytes_of(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def keepers(seen: DataFrame, folder: str, bytes_per_batch: int, on_hits: Callable[[DataFrame, int], None]) -> DataFrame:
    """Streams the table of arrivals through the keyed state: (digest, keeper, group_size).

    seen: a table in `folder` with digest, doc_id and locator.  Each micro-batch writes the
    entries that it changed, the newest of a digest holds, and gives the digests with more than one
    row to `on_hits`.
    """
    spark = seen.sparkSession
    changed = scratch_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        state = (
            spark.readStream.schema(seen.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", FILE, ROW)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )

        def write(rows: DataFrame, batch: int) -> None:
            path = f"{changed}/batch={batch}"
            rows.write.mode("overwrite").parquet(path)
            entries = spark.read.schema(rows.schema).parquet(path)
            on_hits(entries.where("group_size > 1").select("digest"), batch)

        (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", scratch_path(spark, "dedup-stream"))
            .queryName(f"dedup-{uuid.uuid4().hex[:8]}")
            .foreachBatch(write).start().awaitTermination()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    rows = spark.read.schema(state.schema.add("batch", "integer")).option("basePath", changed)
    newest = rows.parquet(changed).groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s"))
    return newest.select("digest", "s.keeper", "s.group_size")


class Comparison:
    """Full bytes of every digest that is hit: compared once, in the batch of its first hit.

    The smallest and the largest text of a digest are equal, or it is shared by different texts.  Both
    are partial aggregates; no group meets in one task.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.compared, self.shared = (scratch_path(rows.sparkSession, n) for n in ("compared", "shared-digests"))

    def _written(self, path: str, until: int | None = None) -> DataFrame:
        spark = self.rows.sparkSession
        batches = [b for b in map(int, folder_values(spark, path, "batch")) if until is None or b < until]
        schema = self.rows.select("digest").schema
        return spark.read.schema(schema).parquet(*(f"{path}/batch={b}" for b in batches)) if batches else spark.createDataFrame([], schema)

    def batch(self, hits: DataFrame, batch: int) -> None:
        """For `keepers`.  A batch that runs twice writes the same."""
        path = f"{self.compared}/batch={batch}"
        if batch:
            hits = hits.join(self._written(self.compared, batch), "digest", "left_anti")
        hits.write.mode("overwrite").parquet(path)
        fresh = self.rows.sparkSession.read.schema(hits.schema).parquet(path)
        texts = self.rows.join(bounded_broadcast(fresh), "digest", "left_semi")
        apart = texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b")
        apart.select("digest").write.mode("overwrite").parquet(f"{self.shared}/batch={batch}")

    def different(self) -> DataFrame:
        """Digests of several texts."""
        return self._written(self.shared)


def exact_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256, bytes_per_batch: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, FILE, ROW (its locator), keep_id, group_size, kept.

    Equal texts form a group and its row with the largest id is kept; among rows with that id one
    is kept.  A null text counts as empty, a null id as smaller than any other.  A text is read whole
    and may be as long as a cell can be; it is shuffled only if its digest occurs again.  An empty
    table gives an empty result.  Other columns are ignored, whatever their names.  Without
    `bytes_per_batch` the narrow rows are streamed in about BATCHES micro-batches.
    """
    return _groups(with_row_keys(docs.select(doc_id, text)), text, doc_id, digest, bytes_per_batch)


def _groups(
    keyed: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column], bytes_per_batch: int | None,
    batches: int = BATCHES,
) -> DataFrame:
    spark = keyed.sparkSession
    rows = arrivals(keyed, text, doc_id, digest)
    folder = scratch_path(spark, "arrivals")
    rows.drop("text").write.parquet(folder)
    seen = spark.read.schema(rows.drop("text").schema).parquet(folder)
    mine = F.struct("doc_id", FILE, ROW)
    columns = ["doc_id", FILE, ROW, F.col("keeper.doc_id").alias("keep_id"), "group_size",
               mine.eqNullSafe(F.col("keeper")).alias("kept"), "digest"]
    if not seen.take(1):
        empty = seen.withColumn("keeper", mine).withColumn("group_size", F.lit(0).cast("long"))
        return empty.select(*columns)
    compared = Comparison(rows)
    limit = bytes_per_batch or max(1, -(-bytes_of(spark, folder) // batches))
    state = stored(keepers(seen, folder, limit, compared.batch), "keepers")
    shared = compared.different()

    plain = seen.join(state, "digest")
    if not shared.take(1):
        return plain.select(*columns)
    apart = rows.join(shared, "digest", "left_semi")
    by_text = apart.groupBy("text").agg(F.max(mine).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    return plain.join(shared, "digest", "left_anti").select(*columns).unionByName(
        apart.join(by_text, "text").select(*columns)
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = 1) -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`.

    As a stage among others it streams its table in one micro-batch: the native memory of the state
    stores of several stays with the executors for the stages that follow.
    """
    inner, (text, doc_id) = set_aside(docs, text, doc_id)
    keyed = with_row_keys(inner)
    groups = _groups(keyed, text, doc_id, sha256, None, batches)
    dropped = bounded_broadcast(groups.where(~F.col("kept")).select(FILE, ROW))
    return restored(keyed.join(dropped, [FILE, ROW], "left_anti"), docs)
