"""Forecast evaluation: predictions against outcomes and against a reference forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesmill.functions.states import average, merge_states, stats_state, stddev, variance
from seriesmill.functions.timecols import floor_time, moment, shift_time
from seriesmill.operators.latest import latest_per_key
from seriesmill.operators.ordered import carry, value_cells
from seriesmill.operators.quantiles import exact_quantiles
from seriesmill.session import cut
from seriesmill.sources.scans import time_range

# Labels of the winner code and of the summary rows.
MODEL_LABEL = "ML"
OFFICIAL_LABEL = "Fingrid"
TIE_LABEL = "Tie"
MAE_METRIC = "Mean Absolute Error (EUR/MWh)"
WIN_RATE_METRIC = "Win Rate (%)"


def bucket_totals(
    predictions: DataFrame,
    actuals: DataFrame,
    *,
    every: str = "1 hour",
    value_grain: float = 1.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Totals over all (prediction, actual) pairs that share a time bucket, per model.

    A bucket with p predictions and a actuals has p * a pairs.  They are never made: counts
    and squares follow from the moments of the two sides, and absolute errors and interval
    hits from running totals of the actuals in value order, which costs (p + a) log(p + a).

    Columns: bucket, model_type, n (predictions), rows / known (actuals with and without NULL
    values), states of both sides, the interval width state, and pair sums of absolute error,
    relative error and hits.
    """
    p = predictions.select(
        floor_time(predictions, "timestamp", every).alias("bucket"),
        "model_type", "model_version", "generated_at",
        F.col("predicted_consumption_mw").alias("p"),
        F.col("confidence_lower").alias("lo"),
        F.col("confidence_upper").alias("hi"),
    )
    a = actuals.select(
        floor_time(actuals, "time", every).alias("bucket"), F.col("consumption_mw").alias("a")
    )
    inverse = F.when(F.col("a") != 0, 1.0 / F.col("a"))
    per_bucket = a.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        stats_state(F.col("a")).alias("actual"),
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("sum_a"),
        F.count(inverse).alias("nonzero"),
        F.coalesce(F.sum(inverse), F.lit(0.0)).alias("sum_inv"),
    )
    # Probes ask for running totals at a value: those of side 1 include equal actuals.  The
    # point probe also carries what the statistics of the predictions need.
    sane = F.col("lo") <= F.col("hi")
    probe = lambda kind, x, side: F.struct(
        F.lit(kind).alias("kind"), F.col(x).alias("x"), F.lit(side).alias("side")
    )
    asked = p.withColumn("width", F.col("hi") - F.col("lo")).select(
        "bucket", "model_type",
        F.explode(F.array_compact(F.array(
            probe("p", "p", 1), F.when(sane, probe("hi", "hi", 1)), F.when(sane, probe("lo", "lo", -1))
        ))).alias("q"),
        "width", "model_version", "generated_at",
    ).select("bucket", "model_type", "q.*", "width", "model_version", "generated_at")
    bound = a.select("bucket").unionByName(
        p.select("bucket", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("bucket")
    )
    # Equal actuals of a bucket are one row with their count.
    given = a.where(F.col("a").isNotNull()).groupBy("bucket", "a").agg(F.count(F.lit(1)).alias("c")).select(
        "bucket",
        F.col("a").alias("x"),
        F.lit(0).alias("side"),
        F.col("c").cast("double").alias("c"),
        (F.col("c") * F.col("a")).alias("s"),
        F.when(F.col("a") != 0, F.col("c")).otherwise(0).cast("double").alias("z"),
        F.when(F.col("a") != 0, F.col("c") / F.col("a")).otherwise(0.0).alias("i"),
    )
    ordered = carry(
        given.unionByName(asked, allowMissingColumns=True),
        ["x", "side"], ["bucket"],
        {"c_le": ("sum", "c"), "s_le": ("sum", "s"), "z_le": ("sum", "z"), "i_le": ("sum", "i")},
        cells=value_cells("x", value_grain), max_rows=max_rows, bound=bound,
    ).where(F.col("side") != 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    point = F.col("kind") == "p"
    value, width = F.when(point, F.col("x")), F.when(point, F.col("width"))
    per_model = ordered.groupBy("bucket", "model_type").agg(
        F.count_if(point).alias("n"),
        stats_state(value).alias("predicted"),
        stats_state(width).alias("width"),
        F.sum(value).alias("sum_p"),
        F.sum(F.when(point, 2 * F.col("x") * zero("c_le") - 2 * zero("s_le"))).alias("abs_part"),
        F.sum(F.when(point, 2 * F.col("x") * zero("i_le") - 2 * zero("z_le"))).alias("rel_part"),
        F.sum(
            F.when(F.col("kind") == "hi", zero("c_le")).when(F.col("kind") == "lo", -zero("c_le")).otherwise(0.0)
        ).alias("hits"),
        F.max(F.when(point, F.col("model_version"))).alias("model_version"),
        F.max(F.when(point, F.col("generated_at"))).alias("generated_at"),
    )
    joined = per_model.join(per_bucket, "bucket")
    known = F.col("actual.n")
    return joined.select(
        "bucket", "model_type", "n", "rows", "predicted", "width", "actual",
        "model_version", "generated_at", "nonzero",
        F.when(
            known > 0,
            F.col("abs_part") + F.col("predicted.n") * F.col("sum_a") - F.col("sum_p") * known,
        ).alias("abs_sum"),
        F.when(
            F.col("nonzero") > 0,
            F.col("rel_part") + F.col("predicted.n") * F.col("nonzero") - F.col("sum_p") * F.col("sum_inv"),
        ).alias("rel_sum"),
        "hits",
    )


def _pair_state(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def accuracy_hourly(
    predictions: DataFrame, actuals: DataFrame, as_of: str, *, max_rows: int | None = None
) -> DataFrame:
    """Hourly accuracy per model over predictions older than one hour, with stored states."""
    due = predictions.where(
        F.col("timestamp") < shift_time(moment(predictions, "timestamp", as_of), -1)
    )
    t = bucket_totals(due, actuals.where(F.col("time") < moment(actuals, "time", as_of)), max_rows=max_rows)
    n, rows, known = F.col("n"), F.col("rows"), F.col("actual.n")
    scored = F.col("predicted.n")
    pairs = scored * known
    p_mean, p_m2 = F.col("predicted.mean"), F.col("predicted.m2")
    a_mean, a_m2 = F.col("actual.mean"), F.col("actual.m2")
    return t.select(
        F.col("bucket").alias("hour"),
        "model_type",
        (n * rows).alias("prediction_count"),
        _pair_state(n * known, a_mean, a_m2 * n).alias("actual_stats"),
        _pair_state(scored * rows, p_mean, p_m2 * rows).alias("predicted_stats"),
        _pair_state(pairs, F.when(known > 0, p_mean - a_mean), p_m2 * known + a_m2 * scored).alias("error_stats"),
        (F.col("abs_sum") / F.nullif(pairs, F.lit(0))).alias("mae_mw"),
        (F.col("rel_sum") / F.nullif(scored * F.col("nonzero"), F.lit(0)) * 100).alias("mape_percent"),
        (F.col("hits") / (n * rows) * 100).alias("coverage_percent"),
        _pair_state(F.col("width.n") * rows, F.col("width.mean"), F.col("width.m2") * rows).alias(
            "interval_width_stats"
        ),
    )


def accuracy_hourly_report(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        "hour",
        "model_type",
        "prediction_count",
        average("actual_stats").alias("actual_avg_mw"),
        stddev("actual_stats").alias("actual_std_mw"),
        average("predicted_stats").alias("predicted_avg_mw"),
        stddev("predicted_stats").alias("predicted_std_mw"),
        average("error_stats").alias("bias_mw"),
        stddev("error_stats").alias("error_std_mw"),
        F.sqrt(variance("error_stats")).alias("rmse_mw"),
        "mae_mw",
        "mape_percent",
        "coverage_percent",
        average("interval_width_stats").alias("avg_interval_width_mw"),
    )


def accuracy_daily(hourly: DataFrame) -> DataFrame:
    """Daily rollup by merging states; MAE, MAPE and coverage are plain means of the hours."""
    merged = [
        merge_states(c).alias(f"daily_{c}")
        for c in ("actual_stats", "predicted_stats", "error_stats", "interval_width_stats")
    ]
    return hourly.groupBy(floor_time(hourly, "hour", "1 day").alias("day"), "model_type").agg(
        F.sum("prediction_count").alias("total_predictions"),
        *merged,
        F.avg("mae_mw").alias("avg_mae_mw"),
        F.avg("mape_percent").alias("avg_mape_percent"),
        F.avg("coverage_percent").alias("avg_coverage_percent"),
    )


def accuracy_daily_report(daily: DataFrame) -> DataFrame:
    return daily.select(
        "day",
        "model_type",
        "total_predictions",
        average("daily_actual_stats").alias("avg_actual_mw"),
        average("daily_predicted_stats").alias("avg_predicted_mw"),
        average("daily_error_stats").alias("avg_bias_mw"),
        F.sqrt(variance("daily_error_stats")).alias("avg_rmse_mw"),
        "avg_mae_mw",
        "avg_mape_percent",
        "avg_coverage_percent",
        average("daily_interval_width_stats").alias("avg_interval_width_mw"),
    )


def model_comparison(
    predictions: DataFrame, actuals: DataFrame, as_of: str, hours: int = 24, *, max_rows: int | None = None
) -> DataFrame:
    """Per model over the last `hours` hours, the newest hour left out."""
    now = moment(predictions, "timestamp", as_of)
    recent = predictions.where(
        (F.col("timestamp") >= shift_time(now, -hours)) & (F.col("timestamp") < shift_time(now, -1))
    )
    # The hours of these predictions, and no other part of the history.
    end = moment(actuals, "time", as_of)
    known = (F.col("time") >= F.date_trunc("hour", shift_time(end, -hours))) & (F.col("time") < end)
    t = bucket_totals(recent, actuals.where(known), max_rows=max_rows)
    scored, known = F.col("predicted.n"), F.col("actual.n")
    error = F.col("predicted.mean") - F.col("actual.mean")
    squares = F.col("predicted.m2") * known + F.col("actual.m2") * scored + scored * known * error * error
    sums = t.groupBy("model_type").agg(
        F.sum(F.col("n") * F.col("rows")).alias("prediction_count"),
        F.sum(scored * known).alias("pairs"),
        F.sum("abs_sum").alias("abs_sum"),
        F.sum(squares).alias("squares"),
        F.sum("hits").alias("hits"),
        F.max("model_version").alias("latest_version"),
        F.max("generated_at").alias("latest_prediction_time"),
    )
    pairs = F.nullif(F.col("pairs"), F.lit(0))
    mae = F.col("abs_sum") / pairs
    spread = F.greatest(F.col("squares") - F.col("pairs") * mae * mae, F.lit(0.0))
    return sums.select(
        "model_type",
        "prediction_count",
        mae.alias("mae_mw"),
        F.sqrt(F.col("squares") / pairs).alias("rmse_mw"),
        F.when(F.col("pairs") > 1, F.sqrt(spread / (F.col("pairs") - 1))).alias("mae_std_mw"),
        (F.col("hits") / F.col("prediction_count") * 100).alias("coverage_percent"),
        "latest_version",
        "latest_prediction_time",
    )


def _absolute(forecast: str) -> Column:
    return F.abs(F.col(forecast) - F.col("actual_price"))


def error_columns() -> dict[str, Column]:
    """Errors of model and official forecast; NULL inputs give NULL, actual 0 has no percentage."""
    share = F.abs(F.nullif(F.col("actual_price"), F.lit(0.0)))
    model, official = _absolute("ml_prediction"), _absolute("official_price_forecast")
    return {
        "ml_absolute_error": model,
        "ml_percentage_error": model / share * 100,
        "official_absolute_error": official,
        "official_percentage_error": official / share * 100,
        "winner_code": F.signum(official - model).cast("int"),
    }


def price_comparison(
    predictions: DataFrame,
    forecasts: DataFrame,
    prices: DataFrame,
    as_of: str,
    *,
    model_type: str = "production",
    area: str = "FI",
    price_type: str = "imbalance",
    since: str | None = None,
) -> DataFrame:
    """Newest model run and newest official price forecast per time, next to the outcome.  `since` bounds
    all three inputs."""
    if since is not None:
        predictions = time_range(predictions, "prediction_time", since)
        forecasts, prices = time_range(forecasts, "forecast_time", since), time_range(prices, "time", since)
    model = latest_per_key(
        predictions.where(
            (F.col("model_type") == model_type)
            & (F.col("prediction_time") < moment(predictions, "prediction_time", as_of))
        ).select(
            F.col("prediction_time").alias("time"),
            F.col("predicted_price_eur_mwh").alias("ml_prediction"),
            F.col("confidence_lower").alias("ml_lower"),
            F.col("confidence_upper").alias("ml_upper"),
            "model_type",
            "model_version",
            F.col("generated_at").alias("prediction_generated_at"),
        ),
        ["time"], ["prediction_generated_at"],
    )
    official = forecasts.where(F.col("forecast_type") == "price").groupBy(
        F.col("forecast_time").alias("time")
    ).agg(F.max_by("value", "generated_at").alias("official_price_forecast"))
    outcome = prices.where((F.col("area") == area) & (F.col("price_type") == price_type)).select(
        "time", F.col("price_eur_mwh").alias("actual_price")
    )
    return model.join(official, "time", "left").join(outcome, "time", "left").withColumns(error_columns())


def winner_label() -> Column:
    """Code to label; NULL (nothing to compare) counts as a tie."""
    return (
        F.when(F.col("winner_code") == 1, MODEL_LABEL)
        .when(F.col("winner_code") == -1, OFFICIAL_LABEL)
        .otherwise(TIE_LABEL)
    )


def win_rate() -> Column:
    """Aggregate: share of rows won by the model, NULL for no rows."""
    return F.count_if(F.col("winner_code") == 1) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100


def performance_hourly(comparison: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hourly error statistics over rows with an outcome.  The comparison is evaluated once and written."""
    known = comparison.where(F.col("actual_price").isNotNull())
    rows = cut(known.select(
        floor_time(known, "time", "1 hour").alias("hour"), "ml_absolute_error", "ml_percentage_error", "official_absolute_error",
        "official_percentage_error", "winner_code", "actual_price"))
    main = rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("num_predictions"),
        F.avg("ml_absolute_error").alias("ml_avg_error"),
        F.avg("ml_percentage_error").alias("ml_avg_pct_error"),
        F.avg("official_absolute_error").alias("official_avg_error"),
        F.avg("official_percentage_error").alias("official_avg_pct_error"),
        win_rate().alias("ml_win_rate_pct"),
        F.avg("actual_price").alias("avg_actual_price"),
        F.min("actual_price").alias("min_actual_price"),
        F.max("actual_price").alias("max_actual_price"),
    )
    median = exact_quantiles(rows, ["hour"], "ml_absolute_error", {"ml_median_error": 0.5}, max_rows, written=True)
    return main.join(median, "hour")


def _recent(comparison: DataFrame, as_of: str, hours_back: int) -> DataFrame:
    return comparison.where(
        (F.col("time") >= shift_time(moment(comparison, "time", as_of), -hours_back))
        & F.col("actual_price").isNotNull()
        & F.col("official_price_forecast").isNotNull()
    )


def _rounded(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def performance_summary(comparison: DataFrame, as_of: str, hours_back: int = 24) -> DataFrame:
    """Two rows: mean absolute errors with the improvement, and the win rate."""
    one = _recent(comparison, as_of, hours_back).agg(
        F.avg("ml_absolute_error").alias("m"),
        F.avg("official_absolute_error").alias("o"),
        win_rate().alias("w"),
    )
    nothing = F.lit(None).cast("double")
    errors = F.struct(
        F.lit(MAE_METRIC).alias("metric"),
        _rounded(F.col("m"), 2).alias("ml_value"),
        _rounded(F.col("o"), 2).alias("official_value"),
        _rounded((F.col("o") - F.col("m")) / F.nullif(F.col("o"), F.lit(0.0)) * 100, 1).alias("improvement_pct"),
    )
    wins = F.struct(
        F.lit(WIN_RATE_METRIC).alias("metric"),
        _rounded(F.col("w"), 1).alias("ml_value"),
        nothing.alias("official_value"),
        nothing.alias("improvement_pct"),
    )
    return one.select(F.explode(F.array(errors, wins)).alias("r")).select("r.*")


# Names of weekdays (Sunday first), parts of the day and seasons.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
DAY_PARTS = ["Night (likely cold)", "Morning", "Afternoon", "Evening"]
SEASONS = ["Winter (high wind)", "Spring", "Summer (low wind)", "Autumn"]


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def condition(group_by: str) -> Column:
    """Label of a row's group: `hour`, `day_of_week`, `temperature` (part of day), `wind` (season)."""
    time = F.col("time")
    if group_by == "hour":
        return F.concat(F.lit("Hour: "), F.hour(time).cast("string"), F.lit(":00"))
    if group_by == "day_of_week":
        return F.concat(F.lit("Day: "), _pick(WEEKDAYS, F.dayofweek(time) - 1))
    if group_by == "temperature":
        return F.concat(F.lit("Period: "), _pick(DAY_PARTS, F.floor(F.hour(time) / 6).cast("int")))
    month = F.month(time)
    season = F.when(month.isin(11, 12, 1, 2), 0).when(month <= 5, 1).when(month <= 8, 2).otherwise(3)
    return F.concat(F.lit("Season: "), _pick(SEASONS, season))


def win_conditions(
    comparison: DataFrame, as_of: str, *, hours_back: int = 720, group_by: str = "hour", min_cases: int = 10
) -> DataFrame:
    return (
        _recent(comparison, as_of, hours_back)
        .groupBy(condition(group_by).alias("condition"))
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            F.count_if(F.col("winner_code") == 1).alias("ml_wins"),
            win_rate().alias("win_rate"),
            F.avg("ml_absolute_error").alias("avg_ml_error"),
            F.avg("official_absolute_error").alias("avg_official_error"),
        )
        .where(F.col("total_cases") >= min_cases)
        .orderBy(F.desc("win_rate"))
    )


def outcome_counts(comparison: DataFrame) -> DataFrame:
    """Total rows, rows with an outcome, wins, and the win rate over rows with an outcome."""
    known = F.count_if(F.col("actual_price").isNotNull())
    won = F.count_if((F.col("winner_code") == 1) & F.col("actual_price").isNotNull())
    return comparison.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        known.alias("with_actuals"),
        won.alias("ml_wins"),
        F.coalesce(won / F.nullif(known, F.lit(0)) * 100, F.lit(0.0)).alias("win_rate"),
    )


ALERT_BELOW = 45.0


def win_rate_alert(comparison: DataFrame, threshold: float = ALERT_BELOW) -> DataFrame:
    return outcome_counts(comparison).withColumn("alert", F.col("win_rate") < threshold)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE (over non-zero actuals, NaN without any) in one pass."""
    a, p = F.col(actual), F.col(predicted)
    error = a - p
    scored = df.where(a.isNotNull() & p.isNotNull())
    sums = scored.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(a).alias("var"),
        F.avg(F.when(a != 0, F.abs(error / F.nullif(a, F.lit(0.0))))).alias("ape"),
    )
    return sums.select(
        "samples",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.nullif(F.col("var"), F.lit(0.0))).alias("r2"),
        F.coalesce(F.col("ape") * 100, F.lit(float("nan"))).alias("mape"),
    )
