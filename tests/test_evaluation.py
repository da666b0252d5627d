"""Pair-free evaluation against all pairs, exact quantiles, comparison rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.states import average, merge_states, stats_state, stddev
from seriesmill.operators import evaluation as ev
from seriesmill.operators.quantiles import exact_quantiles

AS_OF = "2024-01-03 00:00:00"


def tables(spark, seed=3):
    """A hot hour with most rows, NULL and zero actuals, repeated values, reversed bounds."""
    rng = np.random.default_rng(seed)
    hours = np.where(rng.random(300) < 0.5, 5, rng.integers(0, 24, 300))
    p = rng.normal(10, 4, 300).round(1)
    predictions = pd.DataFrame({
        "timestamp": pd.Timestamp("2024-01-02") + pd.to_timedelta(hours, unit="h"),
        "predicted_consumption_mw": p, "confidence_lower": p - rng.integers(0, 6, 300), "confidence_upper": p + rng.integers(-1, 6, 300),
        "model_type": rng.choice(["a", "b"], 300), "model_version": "v1", "generated_at": pd.Timestamp("2024-01-01"),
    })
    hours = np.where(rng.random(200) < 0.5, 5, rng.integers(0, 24, 200))
    a = rng.integers(0, 20, 200).astype(float)
    a[rng.random(200) < 0.2] = np.nan
    actuals = pd.DataFrame({
        "time": pd.Timestamp("2024-01-02") + pd.to_timedelta(hours * 60 + rng.integers(0, 60, 200), unit="m"), "consumption_mw": a,
    })
    to = lambda frame, schema: spark.createDataFrame(
        [tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r) for r in frame.itertuples(index=False)], schema
    )
    return predictions, actuals, to(
        predictions, "timestamp timestamp_ntz, predicted_consumption_mw double, confidence_lower double, confidence_upper double, "
        "model_type string, model_version string, generated_at timestamp_ntz"
    ), to(actuals, "time timestamp_ntz, consumption_mw double")


def all_pairs(predictions, actuals):
    pairs = predictions.assign(hour=predictions["timestamp"].dt.floor("h")).merge(
        actuals.assign(hour=actuals["time"].dt.floor("h")), on="hour"
    )
    e = pairs["predicted_consumption_mw"] - pairs["consumption_mw"]
    c = pairs["consumption_mw"]
    return pairs.assign(
        e=e, ae=e.abs(), pe=(e.abs() / c.where(c != 0)) * 100,
        hit=((c >= pairs["confidence_lower"]) & (c <= pairs["confidence_upper"])).astype(float) * 100,
        w=pairs["confidence_upper"] - pairs["confidence_lower"],
    )


@pytest.mark.parametrize("max_rows", [20, 100_000])
def test_accuracy_matches_all_pairs(spark, max_rows):
    predictions, actuals, p, a = tables(spark)
    got = ev.accuracy_hourly_report(ev.accuracy_hourly(p, a, AS_OF, max_rows=max_rows)).toPandas()
    got = got.sort_values(["hour", "model_type"]).reset_index(drop=True)
    pairs = all_pairs(predictions[predictions["timestamp"] < "2024-01-02 23:00:00"], actuals)
    want = pairs.groupby(["hour", "model_type"]).agg(
        prediction_count=("w", "size"), actual_avg_mw=("consumption_mw", "mean"), actual_std_mw=("consumption_mw", "std"),
        predicted_avg_mw=("predicted_consumption_mw", "mean"), predicted_std_mw=("predicted_consumption_mw", "std"),
        bias_mw=("e", "mean"), error_std_mw=("e", "std"), mae_mw=("ae", "mean"), mape_percent=("pe", "mean"),
        coverage_percent=("hit", "mean"), avg_interval_width_mw=("w", "mean"),
    ).reset_index()
    assert list(got["model_type"]) == list(want["model_type"])
    for name in want.columns[2:]:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), atol=1e-8, err_msg=name)


def test_model_comparison_matches_all_pairs(spark):
    predictions, actuals, p, a = tables(spark, 9)
    got = ev.model_comparison(p, a, AS_OF, max_rows=15).orderBy("model_type").toPandas()
    pairs = all_pairs(predictions[predictions["timestamp"] < "2024-01-02 23:00:00"], actuals)
    want = pairs.groupby("model_type").agg(
        n=("w", "size"), mae=("ae", "mean"), std=("ae", "std"), rmse=("e", lambda e: np.sqrt((e**2).mean())), hit=("hit", "mean")
    )
    np.testing.assert_allclose(
        got[["prediction_count", "mae_mw", "mae_std_mw", "rmse_mw", "coverage_percent"]].astype(float), want.astype(float)
    )


def test_no_pairs_in_the_plan(spark):
    _, _, p, a = tables(spark)
    totals = ev.bucket_totals(p, a)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("max_rows", [10, 10_000])
def test_exact_quantiles(spark, max_rows):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y"], 500), "v": rng.normal(0, 5, 500).round(1)})
    data = pd.concat([data, pd.DataFrame({"g": ["one"], "v": [3.0]})])
    df = spark.createDataFrame(data.itertuples(index=False, name=None), "g string, v double").union(spark.sql("SELECT 'x', CAST(NULL AS DOUBLE)"))
    got = exact_quantiles(df, ["g"], "v", {"a": 0.05, "m": 0.5, "z": 1.0}, max_rows).orderBy("g").toPandas()
    want = data.groupby("g")["v"].quantile([0.05, 0.5, 1.0]).unstack()
    np.testing.assert_allclose(got[["a", "m", "z"]].astype(float), want)


def test_states_merge(spark):
    df = spark.range(100).selectExpr("id % 7 AS g", "CAST(id * id AS DOUBLE) AS v")
    merged = df.groupBy("g").agg(stats_state(F.col("v")).alias("s")).agg(merge_states("s").alias("s")).select(average("s"), stddev("s")).first()
    direct = df.agg(F.avg("v"), F.stddev_samp("v")).first()
    assert merged == pytest.approx(tuple(direct))
    single = spark.sql("SELECT 1.0D AS v").agg(stats_state(F.col("v")).alias("s")).select(stddev("s").alias("x")).first()
    assert single.x is None


def test_error_columns(spark):
    rows = spark.sql("""SELECT * FROM VALUES (10.0D, 12.0D, 0.0D), (10.0D, CAST(NULL AS DOUBLE), 8.0D), (10.0D, 9.0D, CAST(NULL AS DOUBLE)),
        (10.0D, 6.0D, 8.0D), (10.0D, 9.0D, 9.0D) AS t(ml_prediction, official_price_forecast, actual_price)""")
    out = rows.withColumns(ev.error_columns()).withColumn("winner", ev.winner_label()).collect()
    assert out[0].ml_percentage_error is None and out[0].winner_code == 1
    assert out[1].official_absolute_error is None and out[1].winner == "Tie"
    assert out[2].ml_absolute_error is None
    assert out[3].winner_code == 0 and out[3].winner == "Tie"
    assert out[4].winner == "Fingrid"


def test_metrics_without_nonzero_actuals(spark):
    df = spark.sql("SELECT 0.0D AS a, 1.0D AS p")
    row = ev.regression_metrics(df, "a", "p").first()
    assert row.mae == 1.0 and np.isnan(row.mape) and row.r2 is None
