"""Registry of the driver's queries, and the tables they read.

The views turn the driver's `events` table into the seven energy tables.  Every view keeps all
rows of `events`; text and DuckDB oracle share one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-25 12:00:00"
START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"

# `TS` stands for the zone-less timestamp type of the engine.
VIEWS: dict[str, str] = {
    "points": """
        SELECT ts AS time, event_id, user_id, value,
               CASE event_type WHEN 'view' THEN 'consumption' WHEN 'click' THEN 'production'
                    WHEN 'purchase' THEN 'wind' WHEN 'signup' THEN 'nuclear' ELSE 'net_import' END AS metric
        FROM events""",
    "power": """
        SELECT time, event_id, user_id,
               CASE WHEN metric = 'consumption' THEN value END AS consumption_mw,
               CASE WHEN metric = 'production' THEN value END AS production_mw,
               CASE WHEN metric = 'wind' THEN value END AS wind_mw,
               CASE WHEN metric = 'nuclear' THEN value END AS nuclear_mw,
               CASE WHEN metric = 'net_import' THEN value - 100 END AS net_import_mw
        FROM points""",
    "prices": """
        SELECT ts AS time, value - 50 AS price_eur_mwh,
               CASE WHEN user_id % 4 = 0 THEN 'SE' ELSE 'FI' END AS area,
               CASE WHEN event_id % 3 = 0 THEN 'day_ahead' ELSE 'imbalance' END AS price_type,
               event_id, user_id
        FROM events""",
    "outcomes": """
        SELECT CAST(date_trunc('hour', time) AS TS) AS time, avg(price_eur_mwh) AS price_eur_mwh, area, price_type
        FROM prices GROUP BY CAST(date_trunc('hour', time) AS TS), area, price_type""",
    "weather": """
        SELECT ts AS time, concat('s', user_id % 3) AS station_id, value / 10 - 25 AS temperature_c,
               CAST(50 + event_id % 50 AS DOUBLE) AS humidity_percent, value / 20 AS wind_speed_ms,
               CAST(event_id % 360 AS DOUBLE) AS wind_direction, CAST(980 + event_id % 60 AS DOUBLE) AS pressure_hpa,
               CASE WHEN event_type = 'error' THEN value / 50 END AS precipitation_mm,
               CAST(event_id % 9 AS DOUBLE) AS cloud_cover,
               CASE WHEN event_type = 'signup' THEN 'forecast' ELSE 'observation' END AS data_type,
               event_id, user_id
        FROM events""",
    "hourly": """
        SELECT CAST(date_trunc('hour', time) AS TS) AS time, avg(consumption_mw) AS consumption_mw,
               avg(production_mw) AS production_mw, avg(wind_mw) AS wind_mw, avg(nuclear_mw) AS nuclear_mw,
               avg(net_import_mw) AS net_import_mw
        FROM power GROUP BY CAST(date_trunc('hour', time) AS TS)""",
    "predictions": """
        SELECT CAST(date_trunc('hour', ts) AS TS) AS timestamp,
               value * (90 + 2 * (event_id % 11)) / 100 AS predicted_consumption_mw,
               value * 4 / 5 AS confidence_lower, value * 6 / 5 AS confidence_upper,
               CASE WHEN user_id % 2 = 0 THEN 'lightgbm' ELSE 'baseline' END AS model_type,
               concat('v', event_id % 3) AS model_version, ts - INTERVAL 1 HOUR AS generated_at
        FROM events""",
    "price_predictions": """
        SELECT CAST(date_trunc('hour', ts) AS TS) AS prediction_time,
               CASE WHEN user_id % 5 = 0 THEN 'candidate' ELSE 'production' END AS model_type,
               concat('v', event_id % 3) AS model_version,
               value - 53 + event_id % 7 AS predicted_price_eur_mwh,
               value - 63 + event_id % 7 AS confidence_lower, value - 43 + event_id % 7 AS confidence_upper,
               ts - INTERVAL 2 HOUR AS generated_at
        FROM events""",
    "forecasts": """
        SELECT CAST(date_trunc('hour', time) AS TS) AS forecast_time,
               CASE WHEN metric = 'net_import' THEN 'price' ELSE metric END AS forecast_type,
               CASE WHEN metric = 'net_import' THEN value - 48 ELSE value END AS value,
               time - INTERVAL 3 HOUR AS generated_at
        FROM points""",
    "weather_forecasts": """
        SELECT CAST(date_trunc('hour', time) AS TS) AS forecast_time, station_id, temperature_c, wind_speed_ms,
               wind_direction, cloud_cover, humidity_percent, pressure_hpa, precipitation_mm,
               CASE WHEN data_type = 'forecast' THEN 'ecmwf' ELSE 'harmonie' END AS forecast_model,
               time - INTERVAL 4 HOUR AS generated_at
        FROM weather""",
    "comparison": """
        SELECT *, CASE WHEN ml_absolute_error < official_absolute_error THEN 1
                       WHEN ml_absolute_error > official_absolute_error THEN -1
                       WHEN ml_absolute_error = official_absolute_error THEN 0 END AS winner_code
        FROM (
            SELECT m.*, o.official_price_forecast, a.actual_price,
                   abs(m.ml_prediction - a.actual_price) AS ml_absolute_error,
                   abs(m.ml_prediction - a.actual_price) / nullif(abs(a.actual_price), 0) * 100 AS ml_percentage_error,
                   abs(o.official_price_forecast - a.actual_price) AS official_absolute_error,
                   abs(o.official_price_forecast - a.actual_price) / nullif(abs(a.actual_price), 0) * 100 AS official_percentage_error
            FROM (
                SELECT prediction_time AS time, predicted_price_eur_mwh AS ml_prediction, confidence_lower AS ml_lower,
                       confidence_upper AS ml_upper, model_type, model_version, generated_at AS prediction_generated_at
                FROM price_predictions WHERE model_type = 'production' AND prediction_time < TIMESTAMP '2024-01-25 12:00:00'
                QUALIFY row_number() OVER (PARTITION BY prediction_time ORDER BY generated_at DESC) = 1
            ) m
            LEFT JOIN (
                SELECT forecast_time AS time, arg_max(value, generated_at) AS official_price_forecast
                FROM forecasts WHERE forecast_type = 'price' GROUP BY forecast_time
            ) o USING (time)
            LEFT JOIN (
                SELECT time, price_eur_mwh AS actual_price FROM outcomes WHERE area = 'FI' AND price_type = 'imbalance'
            ) a USING (time)
        )""",
    "query_log": """
        SELECT CAST(date_trunc('day', ts) AS TS) AS bucket_start_time,
               CASE WHEN event_type = 'signup' THEN NULL ELSE concat('db', user_id % 3) END AS database,
               concat('u', user_id % 7) AS username, concat('SELECT ', props, ' -- ', user_id) AS query,
               user_id AS query_id,
               CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' END AS command_type,
               event_id % 100 + 1 AS calls, value AS mean_exec_time, value * 2 AS max_exec_time,
               value / 2 AS min_exec_time, value * 3 AS total_exec_time, event_id % 1000 AS rows,
               event_id % 500 AS shared_blks_hit, event_id % 37 AS shared_blks_read,
               value / 1000 AS cpu_user_time, value / 5000 AS cpu_sys_time
        FROM events""",
}
# Written with operators in Spark, as a view only in the oracle.
ORACLE_ONLY = {"comparison"}

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """Driver tables and derived views, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self._base(name)
        return self._made[name]

    def _base(self, name: str) -> DataFrame:
        if name not in BASE_TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        if name in ORACLE_ONLY:
            raise AttributeError(name)
        text = VIEWS[name].replace("AS TS)", "AS TIMESTAMP_NTZ)").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
        source = next(s for s in [*VIEWS, "events"] if f"FROM {s}" in text and s != name)
        return self.spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=getattr(self, source))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
# Means of two-digit numbers over 2^k rows often are exact halves of the last digit kept, and
# then the last bit of a sum decides.  The offset moves them off the half in both engines.
OFFSET = "1.23e-8"


def _oracle(sql: str, rounded: list[str]) -> str:
    views = ",\n".join(f"{n} AS ({t.replace('AS TS)', 'AS TIMESTAMP)')})" for n, t in VIEWS.items())
    inner = sql.strip()
    ctes = ""
    if inner.startswith("WITH "):
        ctes, inner = inner[5:].split("\n    MAIN ", 1)
        ctes = ",\n" + ctes
    replaced = ", ".join(f"round({c} + {OFFSET}, {DIGITS}) AS {c}" for c in rounded)
    columns = f"* REPLACE ({replaced})" if rounded else "*"
    return f"WITH {views}{ctes}\nSELECT {columns} FROM ({inner})"


def query(name: str, sql: str | None = None, rounded: str = ""):
    """Registers `f(tables) -> DataFrame`.  `rounded` names the columns that are rounded in both
    engines; in `sql`, extra CTEs are written as `WITH a AS (...)` followed by `MAIN SELECT`."""
    columns = rounded.split()

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            return out.withColumns({c: F.round(F.col(c) + float(OFFSET), DIGITS) for c in columns}) if columns else out

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _oracle(sql, columns)
        return f

    return register


def naive(df: DataFrame, *names: str) -> DataFrame:
    """TIMESTAMP columns without their zone, for the comparison."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})
