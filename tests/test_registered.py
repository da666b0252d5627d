"""A cross-section of the registered queries against their oracles on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

FOLDER = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import normal  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from seriesmill.registered.base import BASE_TABLES  # noqa: E402

NAMES = [
    "a4_resample_weather", "a5_accuracy_hourly_split", "a6_accuracy_daily", "a7_model_comparison", "a9_prices_daily",
    "a13_performance_summary", "a27_metrics_by_user", "a29_refresh_decision", "f5_holiday_features", "f13_training_features",
    "f14_prediction_features", "i1_ingest_actuals", "j2_asof_nearest_split", "j3_asof_backward_split", "j8_price_comparison",
    "k1_upsert_power", "k12_refresh_views", "q4_daily_accuracy", "q9_comparison_report", "r3_late_rows", "s9_decode_observations",
    "s11_station_coordinates", "s13_weather_windows", "w2_rolling_split", "w9_chronological_split",
]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, db, name):
    got = contract.queries()[name](spark, str(FOLDER)).toPandas()
    want = db.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(n == n.lower() for n in contract.queries())
