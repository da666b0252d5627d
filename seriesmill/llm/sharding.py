"""Balanced sharding: longest-processing-time scheduling of groups that must stay together.

Groups are summed in a partial aggregate (a hot group is one number).  The groups that are large
against a shard are scheduled one by one; the small ones are first bundled by hash, so the items
that reach the heap are bounded by the number of shards, not by the table:
at most `shards * FINE` large groups (each holds more than 1 / (shards * FINE) of all bytes) and
`shards * BUNDLES` bundles.  The items go, largest first, to the least-loaded shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import stored

FINE, BUNDLES = 2000, 512
# Every row costs a shard this many bytes besides its text.
ROW_BYTES = 8
ROWS_PER_SLICE = 50_000


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def least_loaded(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Largest item first (ties by key), each to the shard with the smallest load, then number."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(loads)
        placed[key] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard_by_size(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_crc32, size, shard, slot.

    Rows with equal texts get the same shard; sizes of the shards are near equal, as far as the
    largest group allows.  A null text is the empty text.  slot numbers the rows of a shard from 0
    without gaps.  Repeated rows are rows of their own; an empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"),
        # Texts whose hashes collide merely share a shard.
        F.xxhash64(content).alias("group"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        (text_bytes(F.col(text)) + ROW_BYTES).alias("size"),
    ), "sharding-rows")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size")), "sharding-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    count = rows.count()
    bundles = shards * BUNDLES
    bundle = F.pmod(F.col("group"), F.lit(bundles)).cast("int")
    is_large = F.col("size") > total / (shards * FINE)
    items = groups.groupBy(
        F.when(is_large, F.col("group")).alias("group"), F.when(~is_large, bundle).alias("bundle")
    ).agg(F.sum("size").alias("size"))
    # Bounded by shards * (FINE + BUNDLES) rows, whatever the table holds.
    placed = least_loaded(
        [(r["size"], ("group", r["group"]) if r["group"] is not None else ("bundle", r["bundle"])) for r in items.collect()],
        shards,
    )
    of_group = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == "group"], "group long, g int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == "bundle"], "bundle int, b int")
    assigned = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(of_group), "group", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("doc_id", "text_crc32", "size", F.coalesce("g", "b").alias("shard"))
    )
    return numbered(assigned, "shard", shards, count)


def numbered(rows: DataFrame, shard: str, shards: int, count: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.  A shard is numbered in slices of bounded size by
    many tasks; only the slice totals meet."""
    slices = max(16, count // (shards * ROWS_PER_SLICE))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    totals = rows.groupBy(shard, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(shard, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(shard, "slice").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("at", F.row_number().over(within))
        .join(starts, [shard, "slice"])
        .withColumn("slot", F.col("start") + F.col("at") - 1)
        .drop("slice", "start", "at")
    )
