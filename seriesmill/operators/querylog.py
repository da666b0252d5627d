"""Rollups of a query-log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Thresholds and sizes of the reports.
SLOW_MS, SLOW_TOP, BUCKETS_TOP, FREQUENT_TOP = 10, 50, 100, 30


def slow_queries(log: DataFrame, limit: int = SLOW_TOP) -> DataFrame:
    return (
        log.where(F.col("mean_exec_time") > SLOW_MS)
        .withColumn("query_preview", F.substring("query", 1, 100))
        .orderBy(F.desc("mean_exec_time"), "query")
        .limit(limit)
    )


def performance_buckets(log: DataFrame, limit: int = BUCKETS_TOP) -> DataFrame:
    return (
        log.groupBy("bucket_start_time")
        .agg(
            F.countDistinct("query").alias("unique_queries"),
            F.sum("calls").alias("total_calls"),
            F.avg("mean_exec_time").alias("avg_query_time_ms"),
            F.max("max_exec_time").alias("slowest_query_ms"),
            F.sum("total_exec_time").alias("total_db_time_ms"),
        )
        .orderBy(F.desc("bucket_start_time"))
        .limit(limit)
    )


def frequent_queries(log: DataFrame, limit: int = FREQUENT_TOP) -> DataFrame:
    return (
        log.select(
            "query", "calls", "mean_exec_time", "total_exec_time", "rows",
            F.substring("query", 1, 150).alias("query_preview"),
        )
        .orderBy(F.desc("calls"), "query")
        .limit(limit)
    )


def metrics_by_user(log: DataFrame) -> DataFrame:
    """All counters of one (database, user, command) in one pass."""
    sums = ("calls", "total_exec_time", "rows", "shared_blks_hit", "shared_blks_read", "cpu_user_time", "cpu_sys_time")
    return (
        log.where(F.col("database").isNotNull())
        .groupBy("database", "username", F.coalesce("command_type", F.lit("UNKNOWN")).alias("command_type"))
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.avg("mean_exec_time").alias("mean_exec_time"),
            F.max("max_exec_time").alias("max_exec_time"),
        )
    )


def metrics_by_command(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("command_type").isNotNull())
        .groupBy("command_type")
        .agg(
            F.countDistinct("query_id").alias("unique_queries"),
            F.sum("calls").alias("total_calls"),
            F.sum("total_exec_time").alias("total_time_ms"),
            F.avg("mean_exec_time").alias("avg_time_ms"),
            F.sum("rows").alias("total_rows"),
            F.sum("shared_blks_hit").alias("cache_hits"),
            F.sum("shared_blks_read").alias("disk_reads"),
        )
    )


def cache_hit_ratio(log: DataFrame) -> DataFrame:
    hit, read = F.sum("shared_blks_hit"), F.sum("shared_blks_read")
    ratio = hit / F.nullif(hit + read, F.lit(0)) * 100
    return log.agg(F.round(F.coalesce(ratio, F.lit(0.0)).cast("decimal(38,10)"), 2).cast("double").alias(
        "cache_hit_ratio_percent"
    ))
