"""Distributed training, scoring and evaluation of the consumption and price regressors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, NumericType

from seriesmill.functions.timecols import moment, shift_time
from seriesmill.operators.evaluation import regression_metrics
from seriesmill.plans.datasets import chronological_split, feature_names
from seriesmill.session import cut

# Training names and the names the prediction dataset uses for them.
TRAIN_TO_PREDICT = {
    "consumption_mw": "consumption_forecast_mw",
    "production_mw": "production_forecast_mw",
    "wind_mw": "wind_forecast_mw",
    "temperature_c": "temperature",
    "wind_speed_ms": "wind_speed",
    "humidity_percent": "humidity",
    "pressure_hpa": "pressure",
}
# Features that cannot be known for the future.
TRAIN_ONLY = [
    "nuclear_mw", "net_import_mw", "nuclear_share", "import_dependency", "is_importing", "is_exporting",
]
MIN_TRAINING_ROWS, TRAINING_DAYS = 100, 60
Z_95 = 1.96


def align_names(df: DataFrame) -> DataFrame:
    """Copies training columns to their prediction names where those are missing."""
    new = {p: F.col(t) for t, p in TRAIN_TO_PREDICT.items() if t in df.columns and p not in df.columns}
    return df.withColumns(new) if new else df


def price_features_of(df: DataFrame, target: str = "price_eur_mwh") -> list[str]:
    return feature_names(df, [*TRAIN_TO_PREDICT, *TRAIN_ONLY, target])


def as_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Numeric and boolean features as doubles, others are refused."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = [n for n in names if not isinstance(kinds[n], (NumericType, BooleanType))]
    if wrong:
        raise ValueError(f"features must be numeric: {', '.join(wrong)}")
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def require_features(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Prediction dataset is missing required features: {', '.join(missing)}")


# Defaults of the model families.  `xgboost` grows by depth with single rows in a leaf, `lightgbm`
# keeps 20 rows in a leaf, which for small tables gives about its 31 leaves.
FAMILIES = {
    "xgboost": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "maxBins": 256},
    "lightgbm": {
        "maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "maxBins": 255,
        "minInstancesPerNode": 20,
    },
    "gradient_boosting": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8},
    "random_forest": {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2},
    # Consumption model: about 31 leaves per tree.
    "consumption": {
        "maxIter": 1000, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9", "minInstancesPerNode": 20,
    },
}
# Rounds without a smaller error on the validation rows after which a price model stops.
PATIENCE = 50
# The consumption model stops on its own training rows, whose error falls with nearly every tree: it
# stops when a tree lessens the squared error by a smaller share.
STOP_BELOW = 0.005
_VALIDATION = "__validation"


def boosted(family: str) -> bool:
    return family != "random_forest"


def most_trees(family: str) -> int:
    return FAMILIES[family]["maxIter" if boosted(family) else "numTrees"]


def regressor(family: str, target: str, **params):
    if family not in FAMILIES:
        raise ValueError(f"Unknown model type: {family}")
    settings = {"seed": 42, **FAMILIES[family], **params}
    build = GBTRegressor if boosted(family) else RandomForestRegressor
    return build(featuresCol="features", labelCol=target, predictionCol="prediction", **settings)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether the search is over) of the errors after each round: over when the smallest
    error so far is `patience` rounds old."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The boosted model of the first `count` trees of `model`."""
    sc, java = SparkSession.active().sparkContext, model._java_obj
    ml = sc._jvm.org.apache.spark.ml.regression
    trees, weights = sc._gateway.new_array(ml.DecisionTreeRegressionModel, count), sc._gateway.new_array(sc._jvm.double, count)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:count], model.treeWeights)):
        trees[i], weights[i] = tree, float(weight)
    return model._copyValues(GBTRegressionModel(ml.GBTRegressionModel(model.uid, trees, weights)), {model.maxIter: count})


def fit_patiently(family: str, target: str, train: DataFrame, validation: DataFrame, patience: int, **params):
    """Boosting with `patience` rounds: as many rounds as it takes to see that the error on the validation
    rows falls no more, then the trees up to the best round.

    The rounds are doubled until the end is seen.  Trees depend on seed and round alone, so a model of
    fewer rounds has the first trees of a longer one, and is cut from it.
    """
    limit = params.get("maxIter", FAMILIES[family]["maxIter"])
    rounds = min(limit, patience + 10)
    while True:
        model = regressor(family, target, **{**params, "maxIter": rounds}).fit(train)
        keep, over = best_round(model.evaluateEachIteration(validation, "squared"), patience)
        if over or rounds == limit:
            return model if keep == rounds else first_trees(model, keep)
        rounds = min(limit, 2 * rounds)


def fit(
    df: DataFrame, names: Sequence[str], target: str, family: str, validation: DataFrame | None = None,
    patience: int | None = None, **params,
) -> PipelineModel:
    """Imputes missing features by their mean over `df`, assembles and fits.  Features without any
    value are left out by the caller (`usable_features`).

    With `validation` rows (at least one) a boosted family stops early: after `patience` rounds without
    a smaller error on those rows, or, without patience, at the first tree that lessens it by a share
    below STOP_BELOW (`validationTol`).  The trees up to the best round are kept.
    """
    def inputs(rows):
        return as_doubles(rows, names).select(*names, F.col(target).cast("double").alias(target))

    filled = [f"{n}__filled" for n in names]
    rows = inputs(df)
    impute = Imputer(inputCols=list(names), outputCols=filled).fit(rows)
    assemble = VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")
    ready = lambda r: assemble.transform(impute.transform(r)).select("features", target)
    # Every tree reads the rows again: they are assembled once.
    train = cut(ready(rows))
    held = None if validation is None or not boosted(family) else cut(ready(inputs(validation)))
    if held is None or held.isEmpty():
        fitted = regressor(family, target, **params).fit(train)
    elif patience is not None:
        fitted = fit_patiently(family, target, train, held, patience, **params)
    else:
        flagged = train.withColumn(_VALIDATION, F.lit(False)).unionByName(held.withColumn(_VALIDATION, F.lit(True)))
        fitted = regressor(family, target, **{"validationIndicatorCol": _VALIDATION, "validationTol": STOP_BELOW, **params}).fit(flagged)
    return PipelineModel(stages=[impute, assemble, fitted])


def usable_features(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names with at least one value: one aggregate, one row to the driver."""
    seen = df.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if seen[n] > 0]


class TrainedModel:
    """A fitted pipeline with its feature names, metrics and version."""

    def __init__(self, pipeline: PipelineModel, features: list[str], target: str, family: str, version: str, metrics: dict):
        self.pipeline, self.features, self.target = pipeline, features, target
        self.family, self.version, self.metrics = family, version, metrics

    @property
    def trees(self) -> int:
        return self.pipeline.stages[-1].getNumTrees

    def score(self, df: DataFrame) -> DataFrame:
        require_features(df, self.features)
        scored = self.pipeline.transform(as_doubles(df, self.features))
        return scored.drop("features", *[f"{n}__filled" for n in self.features])

    def predict_consumption(self, df: DataFrame) -> DataFrame:
        """Prediction with +-1.96 population standard deviations of all predictions."""
        scored = self.score(df).withColumnRenamed("prediction", "predicted_consumption_mw")
        return spread_interval(scored, "predicted_consumption_mw")

    def predict_price(self, df: DataFrame, confidence: float = 0.95) -> DataFrame:
        """Prediction with an interval from the validation RMSE."""
        scored = self.score(df)
        time = "forecast_time" if "forecast_time" in df.columns else "time"
        point = F.col("prediction")
        rmse = self.metrics.get("val_rmse")
        if rmse is None:
            spread = scored.agg(F.stddev_pop("prediction").alias("__rmse"))
            scored = scored.crossJoin(F.broadcast(spread))
            width = F.col("__rmse")
        else:
            width = F.lit(float(rmse))
        z = normal_quantile(confidence)
        return scored.select(
            F.col(time).alias("prediction_time"),
            point.alias("predicted_price_eur_mwh"),
            (point - z * width).alias("confidence_lower"),
            (point + z * width).alias("confidence_upper"),
        )

    def importance(self, spark: SparkSession) -> DataFrame:
        # A model cut from a longer one has a value up to its last feature that any tree splits by.
        values = self.pipeline.stages[-1].featureImportances.toArray().tolist()
        rows = list(zip(self.features, values + [0.0] * (len(self.features) - len(values))))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = [(self.features, self.target, self.family, self.version, {k: None if v is None else float(v) for k, v in self.metrics.items()})]
        schema = "features array<string>, target string, family string, version string, metrics map<string,double>"
        spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        row = spark.read.parquet(f"{path}/metadata").first()
        pipeline = PipelineModel.load(f"{path}/pipeline")
        return TrainedModel(pipeline, list(row.features), row.target, row.family, row.version, dict(row.metrics))


def normal_quantile(confidence: float) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def spread_interval(df: DataFrame, value: str, z: float = Z_95) -> DataFrame:
    """Bounds from the population standard deviation of the whole column (a one-row join)."""
    spread = df.agg(F.stddev_pop(value).alias("__std"))
    joined = df.crossJoin(F.broadcast(spread))
    return joined.withColumns({
        "confidence_lower": F.col(value) - z * F.col("__std"),
        "confidence_upper": F.col(value) + z * F.col("__std"),
    }).drop("__std")


def rmse_interval(value: Column, rmse: float | Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = normal_quantile(confidence)
    return value - z * rmse, value + z * rmse


def _version() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def value_columns(df: DataFrame, target: str, time: str = "timestamp") -> list[str]:
    """The columns that can be features: numbers and booleans other than the target and the time."""
    return [
        f.name for f in df.schema.fields
        if f.name not in (target, time) and isinstance(f.dataType, (NumericType, BooleanType))
    ]


def train_consumption(
    df: DataFrame, target: str = "consumption_mw", *, version: str | None = None, **params
) -> TrainedModel:
    """Fits on all rows with a known target; stops early on, and has its metrics from, those same rows."""
    known = df.where(F.col(target).isNotNull())
    names = usable_features(known, value_columns(known, target))
    pipeline = fit(known, names, target, "consumption", known, **params)
    model = TrainedModel(pipeline, names, target, "consumption", version or _version(), {})
    scores = regression_metrics(model.score(known), target, "prediction").first()
    model.metrics = {
        "train_rmse": scores.rmse, "train_mae": scores.mae, "train_mape": scores.mape, "train_samples": scores.samples,
        "trees": model.trees,
    }
    return model


def train_price(
    df: DataFrame, target: str = "price_eur_mwh", *, family: str = "xgboost", validation: float = 0.2,
    time: str = "time", version: str | None = None, patience: int | None = PATIENCE, **params,
) -> TrainedModel:
    """Chronological split, fit on the first part, early stop and metrics on the last."""
    aligned = align_names(df)
    train, held_out = chronological_split(aligned, validation, time)
    names = usable_features(train, price_features_of(aligned, target))
    pipeline = fit(train, names, target, family, held_out, patience, **params)
    model = TrainedModel(pipeline, names, target, family, version or _version(), {})
    scores = regression_metrics(model.score(held_out), target, "prediction").first()
    model.metrics = {
        "train_samples": train.count(), "val_samples": scores.samples, "val_mae": scores.mae, "val_rmse": scores.rmse,
        "val_r2": scores.r2, "val_mape": scores.mape, "trees": model.trees,
    }
    return model


class TooFewRows(ValueError):
    """Refusal to train."""


def retrain_price(df: DataFrame, *, time: str = "time", days: int = TRAINING_DAYS, as_of: str | None = None, **options) -> TrainedModel:
    """Trains on the last `days` days before `as_of` (default: the newest time); refuses a training
    set of fewer than 100 rows."""
    end = moment(df, time, as_of) if as_of is not None else F.lit(df.agg(F.max(time)).first()[0]).cast(df.schema[time].dataType)
    recent = df.where((F.col(time) >= shift_time(end, -24 * days)) & (F.col(time) <= end))
    rows = recent.limit(MIN_TRAINING_ROWS).count()
    if rows < MIN_TRAINING_ROWS:
        raise TooFewRows(f"Insufficient training data: {rows} rows, {MIN_TRAINING_ROWS} needed")
    return train_price(recent, time=time, **options)


def back_score(model: TrainedModel, df: DataFrame, start, end, confidence: float = 0.95) -> DataFrame:
    """Scores past rows with the current model, to have something to evaluate."""
    scored = model.predict_price(align_names(df), confidence)
    at = F.col("prediction_time")
    return scored.where(at.between(F.lit(start).cast(scored.schema["prediction_time"].dataType),
                                   F.lit(end).cast(scored.schema["prediction_time"].dataType)))
