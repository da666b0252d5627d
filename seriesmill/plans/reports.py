"""The parameterised queries behind the routes: (tables, parameters) -> DataFrame."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, functions as F

from seriesmill.functions.timecols import moment, shift_time
from seriesmill.operators import evaluation as ev
from seriesmill.operators.freshness import freshness, row_counts
from seriesmill.operators.latest import latest_run_rows, status
from seriesmill.plans.datasets import joined_training_data
from seriesmill.functions.states import average, stddev, variance
from seriesmill.sources.scans import time_range


def zero_if_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def latest_forecast(predictions: DataFrame, limit: int = 24, model_type: str | None = None) -> DataFrame:
    """First rows of the newest run, in time order."""
    rows = predictions if model_type is None else predictions.where(F.col("model_type") == model_type)
    return latest_run_rows(rows, "generated_at").orderBy("timestamp").limit(limit)


def peak(predictions: DataFrame, limit: int = 24, model_type: str | None = None) -> DataFrame:
    """The hour of the forecast with the highest value; the earlier one of equal hours."""
    rows = latest_forecast(predictions, limit, model_type)
    return rows.orderBy(F.desc("predicted_consumption_mw"), "timestamp").limit(1)


def prediction_status(predictions: DataFrame, model_type: str | None = None) -> DataFrame:
    rows = predictions if model_type is None else predictions.where(F.col("model_type") == model_type)
    return status(rows)


def daily_accuracy(daily: DataFrame, as_of: str, days: int = 30, model_type: str | None = None) -> DataFrame:
    report = ev.accuracy_daily_report(daily)
    rows = report.where(F.col("day") > shift_time(moment(report, "day", as_of), -24 * days))
    if model_type is not None:
        rows = rows.where(F.col("model_type") == model_type)
    measures = [c for c in report.columns if c.startswith("avg_")]
    return zero_if_null(rows, measures).orderBy(F.desc("day"), "model_type")


def recent_daily_accuracy(
    predictions: DataFrame, actuals: DataFrame, as_of: str, days: int = 30, model_type: str | None = None
) -> DataFrame:
    """`daily_accuracy` from the predictions and actuals of the period alone: of the whole days after
    as_of - days, no other day being read."""
    since = datetime.fromisoformat(as_of) - timedelta(days=days)
    first = (datetime.combine(since.date(), time.min) + timedelta(days=1)).isoformat(sep=" ")
    rows = time_range(predictions, "timestamp", first, as_of)
    if model_type is not None:
        rows = rows.where(F.col("model_type") == model_type)
    hourly = ev.accuracy_hourly(rows, time_range(actuals, "time", first, as_of), as_of)
    return daily_accuracy(ev.accuracy_daily(hourly), as_of, days, model_type)


def compare_models(predictions: DataFrame, actuals: DataFrame, as_of: str) -> DataFrame:
    """Best model first."""
    return ev.model_comparison(predictions, actuals, as_of).orderBy("mae_mw", "model_type")


def power_hourly_report(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "hour",
        average("consumption_stats").alias("avg_consumption_mw"),
        "max_consumption_mw",
        "min_consumption_mw",
        stddev("consumption_stats").alias("std_consumption_mw"),
        variance("consumption_stats").alias("var_consumption_mw"),
        "avg_production_mw",
        "avg_wind_mw",
        "avg_nuclear_mw",
        "sample_count",
    )


def hourly_consumption(rollup: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    report = power_hourly_report(rollup)
    return report.where(F.col("hour") > shift_time(moment(report, "hour", as_of), -hours)).orderBy(F.desc("hour"))


def analytics_summary(power: DataFrame, weather: DataFrame, predictions: DataFrame, as_of: str) -> DataFrame:
    """One row: best model, row counts, latest prediction time and its age."""
    best = ev.model_comparison(predictions, power, as_of).orderBy("mae_mw", "model_type").limit(1)
    counts = row_counts({"power": power, "weather": weather, "predictions": predictions}).agg(
        *[
            F.max(F.when(F.col("table_name") == t, F.col("row_count"))).alias(f"{t}_rows")
            for t in ("power", "weather", "predictions")
        ]
    )
    latest = freshness(predictions, "timestamp", as_of)
    one = counts.crossJoin(F.broadcast(latest))
    return one.join(
        F.broadcast(best.select(F.col("model_type").alias("best_model"), "mae_mw", "prediction_count")),
        F.lit(True), "left",
    )


def latest_price_predictions(
    predictions: DataFrame, as_of: str, hours_ahead: int = 48, model_type: str = "production", limit: int = 1000
) -> DataFrame:
    """Coming rows of the newest run of a model."""
    newest = latest_run_rows(predictions.where(F.col("model_type") == model_type), "generated_at")
    now = moment(predictions, "prediction_time", as_of)
    at = F.col("prediction_time")
    return newest.where((at >= now) & (at <= shift_time(now, hours_ahead))).orderBy("prediction_time").limit(limit)


COMPARISON_COLUMNS = [
    "time", "ml_prediction", "ml_lower", "ml_upper", "official_price_forecast", "actual_price",
    "ml_absolute_error", "ml_percentage_error", "official_absolute_error", "official_percentage_error",
    "winner", "model_type", "model_version",
]


def comparison_report(
    comparison: DataFrame, as_of: str, hours_back: int = 168, limit: int = 100, only_with_actuals: bool = False
) -> DataFrame:
    """Newest rows first.  Rows without an outcome are removed after the limit."""
    now = moment(comparison, "time", as_of)
    rows = (
        comparison.where(F.col("time").between(shift_time(now, -hours_back), now))
        .withColumn("winner", ev.winner_label())
        .select(*COMPARISON_COLUMNS)
        .orderBy(F.desc("time"))
        .limit(limit)
    )
    return rows.where(F.col("actual_price").isNotNull()) if only_with_actuals else rows


def performance_summary(comparison: DataFrame, as_of: str, hours_back: int = 168) -> DataFrame:
    """Summary rows with the outcome counts of the same period."""
    now = moment(comparison, "time", as_of)
    counts = ev.outcome_counts(comparison.where(F.col("time").between(shift_time(now, -hours_back), now)))
    return ev.performance_summary(comparison, as_of, hours_back).crossJoin(F.broadcast(counts))


def hourly_performance(hourly: DataFrame, as_of: str, hours_back: int = 168) -> DataFrame:
    now = moment(hourly, "hour", as_of)
    return hourly.where(F.col("hour").between(shift_time(now, -hours_back), now)).orderBy(F.desc("hour"))


def recent_hourly_performance(
    predictions: DataFrame, forecasts: DataFrame, prices: DataFrame, as_of: str, hours_back: int = 168, **which: str
) -> DataFrame:
    """`hourly_performance` from the rows of the period alone."""
    since = datetime.fromisoformat(as_of) - timedelta(hours=hours_back)
    first = since.replace(minute=0, second=0, microsecond=0)
    # An hour that began before the period is not part of it.
    first += timedelta(hours=1) if first < since else timedelta()
    rows = ev.price_comparison(predictions, forecasts, prices, as_of, since=first.isoformat(sep=" "), **which)
    return hourly_performance(ev.performance_hourly(rows), as_of, hours_back)


def model_predictions(predictions: DataFrame, model_type: str, limit: int = 24) -> DataFrame:
    return latest_forecast(predictions, limit, model_type)


def weekly_report(comparison: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Summary of the week with the win-rate alert."""
    now = moment(comparison, "time", as_of)
    alert = ev.win_rate_alert(comparison.where(F.col("time").between(shift_time(now, -hours), now)))
    return ev.performance_summary(comparison, as_of, hours).crossJoin(F.broadcast(alert.select("win_rate", "alert")))


def win_share_split(conditions: DataFrame) -> DataFrame:
    """Shares of both sides per condition, and the hour of an hour label."""
    return conditions.select(
        "condition",
        "win_rate",
        (100 - F.col("win_rate")).alias("official_win_rate"),
        F.regexp_extract("condition", r"Hour: (\d+):00", 1).try_cast("int").alias("hour"),
    )


training_rows = joined_training_data
