"""Early stopping: the rounds that are kept, and what a stopped model is."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesmill.plans import models

SMALL = {"maxDepth": 2, "stepSize": 0.5}


@pytest.mark.parametrize("errors, patience, want", [
    ([5, 4, 3, 2, 1], 2, (5, False)), ([5, 4, 3, 3.5, 3.2], 2, (3, True)), ([5, 4, 4.5, 3, 9, 9, 2], 2, (4, True)),
    ([1, 2, 3], 2, (1, True)), ([1, 2], 2, (1, False)), ([3, 3, 3, 3], 3, (1, True)), ([7], 1, (1, False)),
])
def test_best_round(errors, patience, want):
    assert models.best_round(errors, patience) == want


@pytest.fixture(scope="module")
def prices(spark):
    draw = random.Random(5)
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(hours=h), (x := draw.uniform(-1, 1)), draw.uniform(-1, 1), 10 * x + draw.gauss(0, 4)) for h in range(240)]
    return spark.createDataFrame(rows, "time timestamp, a double, b double, price_eur_mwh double").coalesce(1)


def test_stopped_model_is_the_best_of_its_rounds(spark, prices):
    stopped = models.train_price(prices, family="gradient_boosting", version="v", patience=3, **SMALL)
    train, held_out = models.chronological_split(prices)
    whole = models.fit(train, stopped.features, "price_eur_mwh", "gradient_boosting", maxIter=stopped.trees + 3, **SMALL)
    forest = whole.stages[-1]
    errors = forest.evaluateEachIteration(
        whole.stages[1].transform(whole.stages[0].transform(held_out)).select("features", "price_eur_mwh"), "squared")
    assert models.best_round(errors, 3) == (stopped.trees, True)
    assert stopped.trees < models.most_trees("gradient_boosting")
    # The first trees of the longer model are those of the stopped one.
    trees = [t.toDebugString.split("\n", 1)[1] for t in forest.trees]
    assert trees[:stopped.trees] == [t.toDebugString.split("\n", 1)[1] for t in stopped.pipeline.stages[-1].trees]
    assert stopped.metrics["train_samples"] == 192 and stopped.metrics["val_samples"] == 48


def test_consumption_model_stops_on_its_own_rows(spark, prices):
    rows = prices.select(F.col("time").alias("timestamp"), "a", "b", F.col("price_eur_mwh").alias("consumption_mw"))
    model = models.train_consumption(rows, version="v", maxDepth=3, stepSize=0.3)
    assert 1 < model.trees < 1000 and model.metrics["train_samples"] == 240


def test_without_validation_rows_all_rounds_are_kept(spark, prices):
    pipeline = models.fit(prices, ["a", "b"], "price_eur_mwh", "xgboost", prices.limit(0), maxIter=4, maxDepth=2)
    assert pipeline.stages[-1].getNumTrees == 4


def test_families_differ(spark, prices):
    leaves = {}
    for family in ("xgboost", "lightgbm"):
        model = models.fit(prices, ["a", "b"], "price_eur_mwh", family, maxIter=1)
        leaves[family] = model.stages[-1].trees[0].numNodes
    assert leaves["lightgbm"] < leaves["xgboost"]


def test_stopped_model_is_cut_from_the_longer_one(spark, prices, monkeypatch, tmp_path):
    """No round is boosted again for the trees that stay, and the cut model is a whole model: it scores like
    one fitted with as many rounds, lists all features and can be saved."""
    asked, build = [], models.regressor
    monkeypatch.setattr(models, "regressor", lambda *a, **b: (asked.append(b["maxIter"]), build(*a, **b))[1])
    options = {"patience": 3, "maxDepth": 1, "stepSize": 0.5}
    rows = prices.withColumn("unused", F.lit(1.0)).select("time", "a", "b", "unused", "price_eur_mwh")
    stopped = models.train_price(rows, family="gradient_boosting", version="v", **options)
    assert 1 < stopped.trees < asked[-1] and asked == [13 * 2**k for k in range(len(asked))]
    train, held_out = models.chronological_split(rows)
    short = models.fit(train, stopped.features, "price_eur_mwh", "gradient_boosting", maxIter=stopped.trees, maxDepth=1, stepSize=0.5)
    want = [r.prediction for r in short.transform(models.as_doubles(held_out, stopped.features)).orderBy("time").collect()]
    assert [r.prediction for r in stopped.score(held_out).orderBy("time").collect()] == want
    listed = {r.feature: r.importance for r in stopped.importance(spark).collect()}
    assert listed == pytest.approx(dict(zip(stopped.features, short.stages[-1].featureImportances.toArray())))
    assert stopped.features == ["a", "b", "unused"] and listed["unused"] == 0
    stopped.save(spark, str(tmp_path / "model"))
    saved = models.TrainedModel.load(spark, str(tmp_path / "model"))
    assert saved.trees == stopped.trees and [r.prediction for r in saved.score(held_out).orderBy("time").collect()] == want
    assert saved.pipeline.stages[-1].getMaxIter() == saved.trees and saved.pipeline.stages[-1].getSeed() == 42
