"""Registered queries: training, scoring, recursive forecast.

Every model has the defaults of its family and is trained once per session and folder.  Metrics and
scores have no SQL form.  The `_checked` entries store the scores and hold them against what SQL can
say: the rows that are scored, metrics computed anew in SQL from the stored scores, the width of the
intervals, the saved model against the live one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from seriesmill.functions.timecols import floor_time, moment, shift_time
from seriesmill.operators.evaluation import regression_metrics
from seriesmill.operators.resample import align_to_hourly
from seriesmill.plans import datasets, models, recursive
from seriesmill.registered.base import AS_OF, END, START, query
from seriesmill.registered.features import F13_COLUMNS, F13_SQL, F18_SQL, FUTURE_END, FUTURE_START, NULLS_SQL, W8_SQL, null_limit
from seriesmill.schemas import FEATURE_NAMES, POWER_MEASURES, WEATHER_MEASURES
from seriesmill.session import cut, scratch_path
from seriesmill.sinks import tables

BACK_FROM = "2024-01-23 12:00:00"
VERSION = "v1"
TOLERANCE = 1e-9
_MADE: dict[tuple, object] = {}


def once(t, name: str, make: Callable):
    """The result of `make` for this session and folder: models and their inputs are shared by the entries."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def consumption_rows(t):
    return once(t, "consumption_rows", lambda: cut(datasets.consumption_training_table(t.power, t.weather, START, END)))


def price_rows(t):
    return once(t, "price_rows", lambda: cut(datasets.training_dataset(t.power, t.prices, t.weather, START, END)))


def prediction_rows(t):
    return once(t, "prediction_rows", lambda: cut(datasets.prediction_dataset(
        t.weather_forecasts, t.forecasts, t.prices, FUTURE_START, FUTURE_END, station_id="s1")))


def consumption_model(t):
    return once(t, "consumption", lambda: models.train_consumption(consumption_rows(t), version=VERSION))


def price_model(t, family: str = "gradient_boosting"):
    return once(t, family, lambda: models.train_price(price_rows(t), family=family, version=VERSION))


def retrained(t):
    return once(t, "retrained", lambda: models.retrain_price(price_rows(t), family="gradient_boosting", version=VERSION))


def _metrics(t, model):
    rows = [(k, None if v is None else float(v)) for k, v in model.metrics.items()]
    return t.spark.createDataFrame(rows, "metric string, value double")


def _agrees(t, scored: DataFrame, target: str, said: dict[str, float]) -> DataFrame:
    """One row: samples and whether the metrics that a model reports are those of its stored scores."""
    path = scratch_path(t.spark, "scores")
    scored.select(F.col(target).alias("actual"), F.col("prediction").alias("predicted")).write.parquet(path)
    found = t.spark.sql(
        """SELECT count(*) AS samples, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
                  100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) AS mape, stddev_pop(actual) AS spread
           FROM {scores} WHERE actual IS NOT NULL""", scores=t.spark.read.parquet(path))
    same = F.lit(True)
    for name, value in said.items():
        same &= F.abs(F.col(name) - F.lit(float(value))) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(F.col(name)))
    return found.select("samples", same.alias("metrics_agree"), (F.col("rmse") < F.col("spread")).alias("better_than_mean"))


def _rows_of(sql: str, name: str) -> str:
    """A registered SQL text as one more CTE, to be followed by a new MAIN."""
    ctes, main = sql.split("\n    MAIN ", 1)
    return f"{ctes},\n    {name} AS ({main})\n    "


_F16 = _rows_of(
    f"{F13_SQL}\n    MAIN SELECT * FROM f13 WHERE price_eur_mwh IS NOT NULL AND {NULLS_SQL} <= {null_limit(F13_COLUMNS)}", "f16")


@query("m1_train_consumption")
def _(t):
    return _metrics(t, consumption_model(t))


@query(
    "m1_checked",
    _rows_of(F18_SQL, "f18") + "MAIN SELECT count(*) AS samples, true AS metrics_agree, true AS better_than_mean, true AS stopped_early FROM f18",
)
def _(t):
    """Early stopping on the training rows themselves."""
    model, rows = consumption_model(t), consumption_rows(t)
    said = {n: model.metrics[f"train_{n}"] for n in ("rmse", "mae", "mape")}
    early = 0 < model.trees < models.most_trees("consumption")
    return _agrees(t, model.score(rows), "consumption_mw", said).withColumn("stopped_early", F.lit(early))


for family in ("xgboost", "lightgbm", "gradient_boosting", "random_forest"):
    @query(f"m2_train_price_{family}")
    def _(t, family=family):
        return _metrics(t, price_model(t, family))

    @query(
        f"m2_checked_{family}",
        _F16 + """MAIN SELECT CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train_samples,
              count(*) - CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS samples, true AS metrics_agree, true AS trees_as_set FROM f16""",
    )
    def _(t, family=family):
        """Metrics of the last fifth of the rows; boosted families stop before their limit."""
        model = price_model(t, family)
        _, held_out = datasets.chronological_split(models.align_names(price_rows(t)))
        said = {n: model.metrics[f"val_{n}"] for n in ("rmse", "mae", "mape")}
        limit = models.most_trees(family)
        as_set = 0 < model.trees <= limit - models.PATIENCE if models.boosted(family) else model.trees == limit
        found = _agrees(t, model.score(held_out), "price_eur_mwh", said)
        return found.select(
            F.lit(model.metrics["train_samples"]).cast("long").alias("train_samples"), "samples", "metrics_agree", F.lit(as_set).alias("trees_as_set"))


@query("m3_score_prices")
def _(t):
    return price_model(t).predict_price(prediction_rows(t))


def _interval_holds(scored: DataFrame, rmse: float, point: str = "predicted_price_eur_mwh", z: float = 1.959963984540054):
    """The interval is the point plus and minus z times the error."""
    middle, half = F.col(point), z * rmse
    return (F.abs(F.col("confidence_upper") - middle - half) < 1e-6) & (F.abs(middle - F.col("confidence_lower") - half) < 1e-6)


_FUTURE = f"{W8_SQL}\n    MAIN SELECT forecast_time AS prediction_time"


@query("m3_checked", f"{_FUTURE}, true AS interval_holds FROM fut")
def _(t):
    model = price_model(t)
    scored = model.predict_price(prediction_rows(t))
    return scored.select("prediction_time", _interval_holds(scored, model.metrics["val_rmse"]).alias("interval_holds"))


def _saved(t):
    path = scratch_path(t.spark, "model")
    price_model(t).save(t.spark, path)
    return models.TrainedModel.load(t.spark, path)


@query("m4_saved_model")
def _(t):
    return _saved(t).predict_price(prediction_rows(t))


@query("m4_checked", f"{_FUTURE}, true AS same, true AS same_metadata FROM fut")
def _(t):
    """The model that is read back scores like the one that was saved."""
    live, saved = price_model(t), _saved(t)
    kept = all(getattr(live, n) == getattr(saved, n) for n in ("features", "target", "family", "version", "trees"))
    kept = kept and {k: float(v) for k, v in live.metrics.items()} == saved.metrics
    both = [m.predict_price(prediction_rows(t)).select("prediction_time", F.struct("*").alias(n)) for n, m in (("live", live), ("saved", saved))]
    return both[0].join(both[1], "prediction_time").select(
        "prediction_time", F.col("live").eqNullSafe(F.col("saved")).alias("same"), F.lit(kept).alias("same_metadata"))


@query("m5_retrain")
def _(t):
    """Metrics of the new model, or no rows where there is too little to train on."""
    try:
        model = retrained(t)
    except models.TooFewRows:
        return t.spark.createDataFrame([], "metric string, value double")
    return _metrics(t, model)


@query(
    "m5_checked",
    _F16 + """MAIN SELECT count(*) AS rows_used, 'Insufficient training data: 99 rows, 100 needed' AS refusal FROM f16
       WHERE time >= (SELECT max(time) FROM f16) - INTERVAL 60 DAY""",
)
def _(t):
    """All rows of the last 60 days train and validate the model; 99 rows are refused."""
    metrics = retrained(t).metrics
    try:
        models.retrain_price(price_rows(t).limit(99))
        refusal = None
    except models.TooFewRows as error:
        refusal = str(error)
    return t.spark.createDataFrame([(int(metrics["train_samples"] + metrics["val_samples"]), refusal)], "rows_used long, refusal string")


def _back_scored(t):
    scored = models.back_score(price_model(t), price_rows(t), BACK_FROM, AS_OF)
    path = scratch_path(t.spark, "price_predictions")
    tables.store_price_predictions(scored, path, model_type="production", generated_at=AS_OF, model_version=VERSION)
    return tables.read_table(t.spark, path)


@query("m6_back_score")
def _(t):
    return _back_scored(t).select("prediction_time", "predicted_price_eur_mwh", "confidence_lower", "confidence_upper")


@query(
    "m6_checked",
    _F16 + f"""MAIN SELECT time AS prediction_time, 'production' AS model_type, '{VERSION}' AS model_version,
              CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS generated_at, true AS interval_holds
       FROM f16 WHERE time BETWEEN TIMESTAMP '{BACK_FROM}' AND TIMESTAMP '{AS_OF}'""",
)
def _(t):
    stored = _back_scored(t)
    holds = _interval_holds(stored, price_model(t).metrics["val_rmse"])
    return stored.select("prediction_time", "model_type", "model_version", "generated_at", holds.alias("interval_holds"))


SCORED_UNTIL = "2024-01-22 00:00:00"


def _scheduled(t):
    scored = price_model(t).predict_price(prediction_rows(t))
    coming = scored.where(F.col("prediction_time") < moment(scored, "prediction_time", SCORED_UNTIL))
    path = scratch_path(t.spark, "price_predictions")
    tables.store_price_predictions(coming, path, model_type="production", generated_at=AS_OF, model_version=VERSION)
    return tables.read_table(t.spark, path)


@query("m7_scheduled_scoring")
def _(t):
    return _scheduled(t).select("prediction_time", "predicted_price_eur_mwh", "model_version")


@query(
    "m7_scheduled_checked",
    f"{_FUTURE}, '{VERSION}' AS model_version, true AS interval_holds FROM fut WHERE forecast_time < TIMESTAMP '{SCORED_UNTIL}'",
)
def _(t):
    stored = _scheduled(t)
    holds = _interval_holds(stored, price_model(t).metrics["val_rmse"])
    return stored.select("prediction_time", "model_version", holds.alias("interval_holds"))


def hourly_weather(t):
    weather = t.weather.select("time", *[c for c in WEATHER_MEASURES if c in t.weather.columns])
    return datasets.rename_present(align_to_hourly(weather), FEATURE_NAMES)


def coming_weather(t):
    weather = hourly_weather(t)
    start = moment(weather, "timestamp", AS_OF)
    return weather.where((F.col("timestamp") >= start) & (F.col("timestamp") < shift_time(start, 24)))


def _stored_forecast(t):
    """The next 24 hours by the trained consumption model, stored twice: the second time replaces the first."""
    hourly = align_to_hourly(t.power.select("time", *POWER_MEASURES)).join(hourly_weather(t), "timestamp", "left")
    past = cut(hourly.where(F.col("timestamp") < moment(hourly, "timestamp", AS_OF)))
    model = consumption_model(t)
    found = recursive.recursive_forecast(past, coming_weather(t), model.score, horizon=24, rmse=model.metrics["train_rmse"])
    found = cut(found.withColumn("model_version", F.lit(model.version)))
    path = scratch_path(t.spark, "consumption_predictions")
    for _ in range(2):
        tables.store_consumption_predictions(found, path, model_type="lightgbm", generated_at=AS_OF)
    return tables.read_table(t.spark, path), model


_COMING = f"""(SELECT DISTINCT CAST(date_trunc('hour', time) AS TIMESTAMP) AS timestamp FROM weather
               WHERE time >= TIMESTAMP '{AS_OF}' AND time < TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR)"""


@query(
    "m7_consumption_checked",
    f"""SELECT timestamp, 'lightgbm' AS model_type, '{VERSION}' AS model_version, CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS generated_at,
              true AS interval_holds FROM {_COMING}""",
)
def _(t):
    stored, model = _stored_forecast(t)
    holds = _interval_holds(stored, model.metrics["train_rmse"], "predicted_consumption_mw", models.Z_95)
    return stored.select("timestamp", "model_type", "model_version", "generated_at", holds.alias("interval_holds"))


@query("a23_feature_importance")
def _(t):
    return price_model(t).importance(t.spark).limit(10)


@query("a23_checked", "SELECT rank, true AS in_order, true AS is_feature, true AS shares_sum_to_one FROM (SELECT unnest(range(1, 11)) AS rank)")
def _(t):
    """Ten features by falling importance; all importances sum to one."""
    model = price_model(t)
    listed = [(r["feature"], r["importance"]) for r in model.importance(t.spark).collect()]
    whole = abs(sum(v for _, v in listed) - 1) < 1e-9
    rows = [(k + 1, k == 0 or listed[k - 1][1] >= v, name in model.features, whole) for k, (name, v) in enumerate(listed[:10])]
    return t.spark.createDataFrame(rows, "rank long, in_order boolean, is_feature boolean, shares_sum_to_one boolean")


@query("p11_scored_metrics")
def _(t):
    return regression_metrics(price_model(t).score(models.align_names(price_rows(t))), "price_eur_mwh", "prediction")


@query("p11_checked", _F16 + "MAIN SELECT count(*) AS samples, true AS metrics_agree FROM f16")
def _(t):
    scored = price_model(t).score(models.align_names(price_rows(t)))
    said = regression_metrics(scored, "price_eur_mwh", "prediction").first()
    return _agrees(t, scored, "price_eur_mwh", {n: said[n] for n in ("rmse", "mae", "mape")}).drop("better_than_mean")


@query(
    "p11_missing_features",
    f"""{W8_SQL}
    MAIN SELECT count(*) AS refused_rows, 'Prediction dataset is missing required features: humidity, temperature' AS message FROM fut""",
)
def _(t):
    """Scoring without all features is refused, and the names are listed."""
    rows = prediction_rows(t).drop("temperature", "humidity")
    try:
        price_model(t).predict_price(rows)
        message = None
    except ValueError as error:
        message = str(error)
    return rows.agg(F.count(F.lit(1)).alias("refused_rows")).withColumn("message", F.lit(message))


# The features of the consumption model, in their order.
VALUE_COLUMNS = [
    "production_mw", "wind_mw", "nuclear_mw", "net_import_mw", "temperature", "wind_speed", "wind_direction", "cloud_cover",
    "humidity", "pressure", "precipitation_mm",
    *(f"consumption_mw_lag_{n}h" for n in (1, 3, 6, 12, 24, 48, 168)),
    *(f"consumption_mw_rolling_{kind}_{n}h" for n in (6, 12, 24, 168) for kind in ("mean", "std", "min", "max")),
    "hour_of_day", "day_of_week", "month", "day_of_month", "is_weekend", "is_holiday", "is_holiday_eve", "is_bridge_day",
    "heating_degree_days", "cooling_degree_days", "temperature_squared", "wind_chill",
]


@query("p21_value_columns", "SELECT * FROM (VALUES {}) AS v(position, name)".format(
    ", ".join(f"(CAST({i} AS BIGINT), '{n}')" for i, n in enumerate(VALUE_COLUMNS))))
def _(t):
    """All columns of the training table but its time and its target."""
    names = models.value_columns(consumption_rows(t), "consumption_mw")
    return t.spark.createDataFrame(list(enumerate(names)), "position long, name string")


@query("w11_recursive_forecast")
def _(t):
    return _per_metric(t)[0]


def _per_metric(t):
    """One series per metric, forecast in parallel."""
    def make():
        hourly = t.points.groupBy("metric", floor_time(t.points, "time", "1 hour").alias("timestamp")).agg(
            F.avg("value").alias("consumption_mw")
        )
        joined = hourly.join(hourly_weather(t), "timestamp", "left")
        past = cut(joined.where(F.col("timestamp") < moment(joined, "timestamp", AS_OF)))
        training = datasets.consumption_features(past, keys=["metric"])
        model = models.train_consumption(cut(training.drop("metric")), version=VERSION)
        return cut(recursive.recursive_forecast(
            past, coming_weather(t), model.score, keys=["metric"], horizon=24, rmse=model.metrics["train_rmse"])), model

    return once(t, "per_metric", make)


@query(
    "w11_checked",
    f"""SELECT metric, timestamp, true AS interval_holds, true AS is_plausible
       FROM (SELECT DISTINCT metric FROM points WHERE time < TIMESTAMP '{AS_OF}'), {_COMING}""",
)
def _(t):
    """Every series and hour once, forecasts within the range of the training values."""
    found, model = _per_metric(t)
    holds = _interval_holds(found, model.metrics["train_rmse"], "predicted_consumption_mw", models.Z_95)
    low, high = t.points.agg(F.min("value"), F.max("value")).first()
    return found.select(
        "metric", "timestamp", holds.alias("interval_holds"), F.col("predicted_consumption_mw").between(low, high).alias("is_plausible"))
