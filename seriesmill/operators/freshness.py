"""Row counts, latest times and freshness decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seriesmill.functions.timecols import micros, moment, shift_time


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def freshness(df: DataFrame, time: str, as_of: str) -> DataFrame:
    """Latest time and its age in hours; NULL for an empty table."""
    age = (micros(moment(df, time, as_of)) - micros(F.col("latest"))) / F.lit(3_600_000_000.0)
    return df.agg(F.max(time).alias("latest")).withColumn("freshness_hours", age)


# Limits and reasons of the price refresh decision.
RUN_HOURS, COMPARISON_HOURS = 6, 12
NO_RUN, NO_COMPARISON = "no recent price predictions", "comparison view empty"


def refresh_decision(predictions: DataFrame, comparison: DataFrame, as_of: str) -> DataFrame:
    """Whether prices must be predicted again, and why: no run within 6 h, or no comparison
    row within 12 h."""
    recent_run = F.col("generated_at") >= shift_time(moment(predictions, "generated_at", as_of), -RUN_HOURS)
    recent_row = F.col("time") >= shift_time(moment(comparison, "time", as_of), -COMPARISON_HOURS)
    runs = predictions.agg(F.coalesce(F.max(recent_run), F.lit(False)).alias("has_recent_predictions"))
    rows = comparison.agg(F.coalesce(F.max(recent_row), F.lit(False)).alias("has_recent_view"))
    reasons = F.concat_ws(
        ", ",
        F.when(~F.col("has_recent_predictions"), F.lit(NO_RUN)),
        F.when(~F.col("has_recent_view"), F.lit(NO_COMPARISON)),
    )
    return runs.crossJoin(F.broadcast(rows)).select(
        "has_recent_predictions",
        "has_recent_view",
        (~(F.col("has_recent_predictions") & F.col("has_recent_view"))).alias("refresh"),
        reasons.alias("reason"),
    )
