"""Registered queries: scalar functions, features, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import calendar, supply, weather
from seriesmill.functions.timecols import bucket_count, floor_time, moment, shift_time, weekday
from seriesmill.operators import history, joins, rules
from seriesmill.operators.latest import latest_per_key
from seriesmill.operators.resample import align_to_hourly
from seriesmill.plans import datasets, models
from seriesmill.registered.base import AS_OF, END, START, naive, query
from seriesmill.registered.temporal import A4_SQL, PIVOT_SQL, Q14_SQL, SPLIT_ROWS
from seriesmill.schemas import FEATURE_NAMES, POWER_MEASURES
from seriesmill.session import bounded_broadcast, cut
from seriesmill.sources import payloads

# --- calendar -----------------------------------------------------------------------------

# Easter by the anonymous Gregorian algorithm, in the oracle's own words.
HOLIDAYS_SQL = """
    y AS (SELECT CAST(range AS INTEGER) AS y FROM range(1949, 2102)),
    e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
    e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
    e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
    e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
    easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS d FROM e4),
    hol AS (
        SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS d FROM easter, (VALUES (-2), (0), (1), (39), (49)) v(k)
        UNION SELECT make_date(y, m, k) FROM y, (VALUES (1, 1), (1, 6), (5, 1), (12, 6), (12, 24), (12, 25), (12, 26)) v(m, k)
        UNION SELECT d FROM (SELECT CAST(make_date(y, 6, 20) + CAST(range AS INTEGER) AS DATE) AS d FROM y, range(0, 7)) WHERE dayofweek(d) = 6
        UNION SELECT d FROM (SELECT CAST(make_date(y, 6, 19) + CAST(range AS INTEGER) AS DATE) AS d FROM y, range(0, 7)) WHERE dayofweek(d) = 5
        UNION SELECT d FROM (SELECT CAST(make_date(y, 10, 31) + CAST(range AS INTEGER) AS DATE) AS d FROM y, range(0, 7)) WHERE dayofweek(d) = 6
    )"""


def holiday_flags(time: str) -> str:
    d = f"CAST({time} AS DATE)"
    has = "EXISTS (SELECT 1 FROM hol WHERE hol.d = {})"
    return f"""{has.format(d)} AS is_holiday, {has.format(f'{d} + 1')} AS is_holiday_eve,
        (isodow({time}) = 5 AND {has.format(f'{d} - 1')}) OR (isodow({time}) = 1 AND {has.format(f'{d} + 1')}) AS is_bridge_day"""


@query("f5_holiday_features", f"WITH {HOLIDAYS_SQL}\n    MAIN SELECT o_orderkey, o_orderdate AS time, {holiday_flags('o_orderdate')} FROM orders")
def _(t):
    return calendar.add_holiday_features(t.orders.select("o_orderkey", F.col("o_orderdate").alias("time")), "time")


@query("j11_holiday_membership", f"""WITH {HOLIDAYS_SQL}
    MAIN SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders, sum(o_totalprice) AS total
    FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT d FROM hol) GROUP BY 1""", rounded="total")
def _(t):
    """Rows on a holiday, by day: membership without a join."""
    day = F.to_date("o_orderdate")
    return t.orders.where(calendar.is_holiday(day)).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))


F1_SQL = "CAST(hour({0}) AS INTEGER) AS hour_of_day, CAST(isodow({0}) AS INTEGER) AS day_of_week, CAST(month({0}) AS INTEGER) AS month, CAST(day({0}) AS INTEGER) AS day_of_month, isodow({0}) >= 5 AS is_weekend"


@query("f1_time_features", f"SELECT event_id, ts AS timestamp, {F1_SQL.format('ts')} FROM events")
def _(t):
    return calendar.add_time_features(t.events.select("event_id", F.col("ts").alias("timestamp")))


CLOCK_SQL = """
    CAST(hour({0}) AS INTEGER) AS hour, CAST(minute({0}) AS INTEGER) AS minute, CAST(isodow({0}) AS INTEGER) AS day_of_week,
    CAST(dayofyear({0}) AS INTEGER) AS day_of_year, CAST(week({0}) AS INTEGER) AS week_of_year, CAST(month({0}) AS INTEGER) AS month,
    CAST(quarter({0}) AS INTEGER) AS quarter, isodow({0}) >= 6 AS is_weekend,
    isodow({0}) <= 5 AND hour({0}) >= 7 AND hour({0}) <= 17 AS is_business_hours,
    (hour({0}) >= 7 AND hour({0}) <= 9) OR (hour({0}) >= 17 AND hour({0}) <= 19) AS is_peak_hours,
    hour({0}) >= 23 OR hour({0}) <= 4 AS is_night_hours"""
CYCLIC_SQL = """
    sin(2 * 3.14159 * hour({0}) / 24) AS hour_sin, cos(2 * 3.14159 * hour({0}) / 24) AS hour_cos,
    sin(2 * 3.14159 * isodow({0}) / 7) AS day_sin, cos(2 * 3.14159 * isodow({0}) / 7) AS day_cos,
    sin(2 * 3.14159 * month({0}) / 12) AS month_sin, cos(2 * 3.14159 * month({0}) / 12) AS month_cos"""
CYCLIC = "hour_sin hour_cos day_sin day_cos month_sin month_cos"


@query("f2_clock_features", f"SELECT o_orderkey, {CLOCK_SQL.format('o_orderdate')} FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").withColumns(calendar.clock_features("o_orderdate")).drop("o_orderdate")


@query(
    "f3_period_flags",
    f"SELECT event_id, is_business_hours, is_peak_hours, is_night_hours FROM (SELECT event_id, {CLOCK_SQL.format('ts')} FROM events)",
)
def _(t):
    flags = calendar.clock_features("ts")
    names = ("is_business_hours", "is_peak_hours", "is_night_hours")
    return t.events.select("event_id", *[flags[n].alias(n) for n in names])


@query("f4_cyclic_features", f"SELECT event_id, {CYCLIC_SQL.format('ts')} FROM events", rounded=CYCLIC)
def _(t):
    clock = t.events.select("event_id", "ts").withColumns(calendar.clock_features("ts"))
    return clock.withColumns(calendar.cyclic_features()).select("event_id", *CYCLIC.split())


# --- weather and supply -------------------------------------------------------------------

CHILL = "13.12 + 0.6215 * {t} - 11.37 * pow({w} * 3.6, 0.16) + 0.3965 * {t} * pow({w} * 3.6, 0.16)"
W_STORED = {"t": "temperature_c", "w": "wind_speed_ms"}
F6_SQL = """CAST(CASE WHEN {t} < 18 THEN 18 - {t} ELSE 0 END AS DOUBLE) AS heating_degree_days,
    CAST(CASE WHEN {t} > 22 THEN {t} - 22 ELSE 0 END AS DOUBLE) AS cooling_degree_days, {t} * {t} AS temperature_squared"""


@query(
    "f6_degree_days",
    f"SELECT event_id, {F6_SQL.format(t='(temperature_c + 30)')} FROM weather",
    rounded="heating_degree_days cooling_degree_days temperature_squared",
)
def _(t):
    warm = t.weather.select("event_id", (F.col("temperature_c") + 30).alias("temperature"))
    return weather.add_weather_interactions(warm).drop("temperature")


@query("f7_wind_chill", f"SELECT event_id, {CHILL.format(**W_STORED)} AS wind_chill FROM weather", rounded="wind_chill")
def _(t):
    return t.weather.select(
        "event_id", weather.wind_chill(F.col("temperature_c"), F.col("wind_speed_ms")).alias("wind_chill")
    )


WEATHER_SQL = """
    CAST(CASE WHEN {t} < 18 THEN 18 - {t} ELSE 0 END AS DOUBLE) AS heating_degree_days,
    {t} < -10 AS is_extreme_cold, {t} >= 0 AND {t} < 10 AS is_mild_cold, {t} < 0 AS is_freezing, {t} * {t} AS temperature_squared,
    {w} < 3 AS is_no_wind, {w} >= 3 AND {w} < 12 AS is_good_wind, {w} >= 12 AS is_high_wind,
    {w} * {w} AS wind_speed_squared, {w} * {w} * {w} AS wind_speed_cubed,
    {p} < 1000 AS is_low_pressure, {p} > 1020 AS is_high_pressure, cloud_cover > 6 AS is_overcast,
    precipitation_mm > 0 AS is_precipitation, precipitation_mm > 5 AS is_heavy_precipitation,
    """ + CHILL + """ AS wind_chill, {t} * {w} AS temp_wind_interaction"""
OBSERVED = {**W_STORED, "p": "pressure_hpa"}
FORECAST = {"t": "temperature", "w": "wind_speed", "p": "pressure"}
WEATHER_DOUBLES = "heating_degree_days temperature_squared wind_speed_squared wind_speed_cubed wind_chill temp_wind_interaction"
GROUPS = {
    "f8_cold_features": ["heating_degree_days", "is_extreme_cold", "is_mild_cold", "is_freezing", "temperature_squared"],
    "f9_wind_features": ["is_no_wind", "is_good_wind", "is_high_wind", "wind_speed_squared", "wind_speed_cubed"],
    "f10_sky_features": [
        "is_low_pressure", "is_high_pressure", "is_overcast", "is_precipitation", "is_heavy_precipitation",
        "temp_wind_interaction",
    ],
}
for key, names in GROUPS.items():
    @query(
        key, f"SELECT event_id, {', '.join(names)} FROM (SELECT event_id, {WEATHER_SQL.format(**OBSERVED)} FROM weather)",
        rounded=" ".join(n for n in names if n in WEATHER_DOUBLES.split()),
    )
    def _(t, names=names):
        new = weather.weather_features(t.weather.columns, "observation")
        return t.weather.select("event_id", *[new[n].alias(n) for n in names])


def supply_sql(c: str, p: str, w: str, n: str | None = None, i: str | None = None) -> str:
    clip = "CASE WHEN {0} < 1 THEN 1 ELSE {0} END"
    parts = [
        f"{p} - {c} AS net_supply_mw, {p} / {clip.format(c)} AS supply_demand_ratio, {p} < {c} AS is_shortage",
        f"({p} - {c}) / {clip.format(c)} < 0.05 AS is_tight_margin",
        f"{w} / {clip.format(p)} AS wind_penetration, {w} > {p} * 0.3 AS is_high_wind_penetration",
    ]
    if n:
        parts.append(f"{n} / {clip.format(p)} AS nuclear_share")
    if i:
        parts.append(f"{i} / {clip.format(c)} AS import_dependency, {i} > 0 AS is_importing, {i} < 0 AS is_exporting")
    return ", ".join(parts)


ACTUAL_SUPPLY = supply_sql(*POWER_MEASURES)
SUPPLY_NAMES = {
    "f11_supply_features": ["net_supply_mw", "supply_demand_ratio", "is_shortage", "is_tight_margin"],
    "f12_share_features": [
        "wind_penetration", "is_high_wind_penetration", "nuclear_share", "import_dependency", "is_importing", "is_exporting",
    ],
}
SUPPLY_DOUBLES = ["net_supply_mw", "supply_demand_ratio", "wind_penetration", "nuclear_share", "import_dependency"]
for key, names in SUPPLY_NAMES.items():
    @query(
        key, f"SELECT time, {', '.join(names)} FROM (SELECT time, {ACTUAL_SUPPLY} FROM hourly)",
        rounded=" ".join(n for n in names if n in SUPPLY_DOUBLES),
    )
    def _(t, names=names):
        return supply.add_supply_features(t.hourly, "actual").select("time", *names)


# --- lags and rolling windows ---------------------------------------------------------------

# Fixed values of the SQL texts, written out here on their own.
SQL_TARGET_LAGS = (1, 3, 6, 12, 24, 48, 168)
SQL_PRICE_LAGS = (1, 2, 3, 24, 48, 168)
SQL_WINDOWS = (6, 12, 24, 168)


def lag_sql(source: str, prefix: str, lags, window: str) -> str:
    return ", ".join(f"lag({source}, {n}) OVER ({window}) AS {prefix}_lag_{n}h" for n in lags)


def rolling_sql(source: str, prefix: str, windows, window: str, full: bool) -> str:
    out = []
    for n in windows:
        frame = f"OVER ({window} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            value = f"{f}({source}) {frame}"
            if full:
                value = f"CASE WHEN count({source}) {frame} = {n} THEN {value} END"
            out.append(f"{value} AS {prefix}_rolling_{name}_{n}h")
    return ", ".join(out)


def rolling_names(prefix: str, windows=SQL_WINDOWS, kinds=("mean", "std", "min", "max")) -> list[str]:
    return [f"{prefix}_rolling_{k}_{n}h" for n in windows for k in kinds]


KEYED = "PARTITION BY user_id ORDER BY time"
GLOBAL = "ORDER BY time"
C = "consumption_mw"


def _lags(t, keys, **options):
    rows = t.points.select("time", "user_id", "value")
    return history.with_frames(
        rows, ["time"], keys, history.lag_columns("value", "value", history.TARGET_LAGS), look_back=168, **options
    )


@query("w1_lags_keyed", f"SELECT time, user_id, value, {lag_sql('value', 'value', SQL_TARGET_LAGS, KEYED)} FROM points")
def _(t):
    return _lags(t, ["user_id"])


@query("w1_lags_split", f"SELECT time, user_id, value, {lag_sql('value', 'value', SQL_TARGET_LAGS, GLOBAL)} FROM points")
def _(t):
    return _lags(t, [], max_rows=SPLIT_ROWS)


W2 = rolling_names("value", kinds=("mean", "std"))


def _rolling(t, keys, full, **options):
    rows = t.points.select("time", "user_id", "value")
    columns = history.rolling_columns("value", "value", history.WINDOWS, full)
    return history.with_frames(rows, ["time"], keys, columns, look_back=168, **options)


@query(
    "w2_rolling_keyed",
    f"SELECT time, user_id, value, {rolling_sql('value', 'value', SQL_WINDOWS, KEYED, False)} FROM points",
    rounded=" ".join(W2),
)
def _(t):
    return _rolling(t, ["user_id"], False)


@query(
    "w2_rolling_split",
    f"SELECT time, user_id, value, {rolling_sql('value', 'value', SQL_WINDOWS, GLOBAL, False)} FROM points",
    rounded=" ".join(W2),
)
def _(t):
    return _rolling(t, [], False, max_rows=SPLIT_ROWS)


@query("w3_price_lags", f"SELECT time, area, price_eur_mwh, {lag_sql('price_eur_mwh', 'price', SQL_PRICE_LAGS, 'PARTITION BY area ORDER BY time')} FROM prices")
def _(t):
    rows = t.prices.select("time", "area", "price_eur_mwh")
    return history.with_frames(
        rows, ["time"], ["area"], history.lag_columns("price_eur_mwh", "price", history.PRICE_LAGS), look_back=168
    )


@query(
    "w4_price_rolling",
    f"SELECT time, user_id, value, {rolling_sql('value', 'value', SQL_WINDOWS, KEYED, True)} FROM points",
    rounded=" ".join(W2),
)
def _(t):
    return _rolling(t, ["user_id"], True)


@query(
    "w4_price_rolling_split",
    f"SELECT time, user_id, value, {rolling_sql('value', 'value', SQL_WINDOWS, GLOBAL, True)} FROM points",
    rounded=" ".join(W2),
)
def _(t):
    return _rolling(t, [], True, max_rows=SPLIT_ROWS)


PRICE_FRAMES_SQL = lag_sql("price_eur_mwh", "price", SQL_PRICE_LAGS, GLOBAL) + ", " + rolling_sql(
    "price_eur_mwh", "price", SQL_WINDOWS, GLOBAL, True
)
DIFFS_SQL = "price_lag_1h - price_lag_2h AS price_diff_1h, price_lag_24h - price_lag_48h AS price_diff_24h"
PRICE_DOUBLES = [f"price_lag_{n}h" for n in SQL_PRICE_LAGS] + rolling_names("price") + ["price_diff_1h", "price_diff_24h"]


@query(
    "w5_price_differences",
    f"SELECT time, {DIFFS_SQL} FROM (SELECT time, {PRICE_FRAMES_SQL} FROM (SELECT * FROM outcomes WHERE area = 'FI' AND price_type = 'imbalance'))",
    rounded="price_diff_1h price_diff_24h",
)
def _(t):
    rows = t.outcomes.where((F.col("area") == "FI") & (F.col("price_type") == "imbalance")).select("time", "price_eur_mwh")
    return history.add_price_history(rows).select("time", "price_diff_1h", "price_diff_24h")


@query(
    "w5_price_differences_keyed",
    f"SELECT time, area, price_type, {DIFFS_SQL} FROM (SELECT time, area, price_type, "
    + PRICE_FRAMES_SQL.replace("ORDER BY time", "PARTITION BY area, price_type ORDER BY time") + " FROM outcomes)",
    rounded="price_diff_1h price_diff_24h",
)
def _(t):
    """Every area and price type is a series of its own."""
    rows = t.outcomes.select("time", "area", "price_type", "price_eur_mwh")
    return history.add_price_history(rows, keys=["area", "price_type"]).select("time", "area", "price_type", "price_diff_1h", "price_diff_24h")


FUTURE_START, FUTURE_END = "2024-01-20 00:00:00", "2024-01-30 00:00:00"
W8_SQL = f"""
    WITH h AS (SELECT time, max(price_eur_mwh) AS price_eur_mwh, false AS future FROM prices
               WHERE area = 'FI' AND time < TIMESTAMP '{FUTURE_START}' AND time >= TIMESTAMP '{FUTURE_START}' - INTERVAL 720 HOUR GROUP BY time),
    fut AS (SELECT DISTINCT ON (forecast_time, station_id) forecast_time, station_id, temperature_c AS temperature, wind_speed_ms AS wind_speed,
                 wind_direction, cloud_cover, humidity_percent AS humidity, pressure_hpa AS pressure, precipitation_mm, forecast_model, generated_at
          FROM weather_forecasts WHERE station_id = 's1' AND forecast_time BETWEEN TIMESTAMP '{FUTURE_START}' AND TIMESTAMP '{FUTURE_END}'
          ORDER BY forecast_time, station_id, generated_at DESC),
    u AS (SELECT *, {PRICE_FRAMES_SQL.replace('ORDER BY time', 'ORDER BY time, future')} FROM (
              SELECT time, price_eur_mwh, future FROM h UNION ALL SELECT forecast_time, NULL, true FROM fut)),
    w8 AS (SELECT time AS forecast_time, * EXCLUDE (time, price_eur_mwh, future), {DIFFS_SQL} FROM u WHERE future)"""


def _stub_hours(t):
    rows = t.weather_forecasts.where((F.col("station_id") == "s1")
        & F.col("forecast_time").between(moment(t.weather_forecasts, "forecast_time", FUTURE_START),
                                         moment(t.weather_forecasts, "forecast_time", FUTURE_END)))
    return latest_per_key(rows, ["forecast_time", "station_id"], ["generated_at"]).select("forecast_time")


@query(
    "w8_price_history_to_future",
    f"{W8_SQL}\n    MAIN SELECT * FROM w8",
    rounded=" ".join(PRICE_DOUBLES),
)
def _(t):
    stubs = _stub_hours(t)
    first = moment(t.prices, "time", FUTURE_START)
    known = t.prices.where((F.col("area") == "FI") & (F.col("time") < first) & (F.col("time") >= shift_time(first, -720)))
    return history.add_price_history_to_future(stubs, known, max_rows=SPLIT_ROWS)


# --- datasets -----------------------------------------------------------------------------

HOURLY_INPUT_SQL = f"""
    pr AS (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, avg(price_eur_mwh) AS price_eur_mwh FROM prices
           WHERE area = 'FI' AND time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1),
    wr AS (SELECT * FROM weather WHERE time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
    we AS ({A4_SQL.replace('FROM weather', 'FROM wr')}),
    hr AS (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, {', '.join(f'avg({m}) AS {m}' for m in POWER_MEASURES)}
           FROM power WHERE time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1),
    inp AS (SELECT hr.*, pr.price_eur_mwh, we.* EXCLUDE (time) FROM hr LEFT JOIN pr USING (time) LEFT JOIN we USING (time))"""
_ALL_WEATHER = "temperature_c wind_speed_ms wind_direction cloud_cover humidity_percent pressure_hpa precipitation_mm".split()
F13_SQL = f"""
    WITH {HOLIDAYS_SQL}, {HOURLY_INPUT_SQL},
    fr AS (SELECT *, {PRICE_FRAMES_SQL} FROM inp),
    f13 AS (SELECT *, {DIFFS_SQL}, {CLOCK_SQL.format('time')}, {CYCLIC_SQL.format('time')}, {holiday_flags('time')},
                   {WEATHER_SQL.format(**OBSERVED)}, {ACTUAL_SUPPLY} FROM fr)"""
F13_DOUBLES = " ".join([
    "price_eur_mwh", *POWER_MEASURES, *_ALL_WEATHER, *PRICE_DOUBLES, CYCLIC, WEATHER_DOUBLES, *SUPPLY_DOUBLES,
])


@query("f13_training_features", f"{F13_SQL}\n    MAIN SELECT * FROM f13", rounded=F13_DOUBLES)
def _(t):
    def inside(df):
        return df.where(F.col("time").between(moment(df, "time", START), moment(df, "time", END)))

    inputs = datasets.hourly_inputs(
        inside(t.power), inside(t.prices).where(F.col("area") == "FI"), inside(t.weather)
    )
    return datasets.training_features(inputs, at_most=bucket_count(START, END, "1 hour"))


def _training(t):
    return datasets.training_dataset(t.power, t.prices, t.weather, START, END)


def null_limit(columns: int) -> int:
    return int(columns * 0.2)


F13_COLUMNS = 6 + 1 + 7 + 6 + 16 + 2 + 11 + 6 + 3 + 17 + 10
NULLS_SQL = " + ".join(
    f"CAST({c} IS NULL AS INTEGER)" for c in
    [*POWER_MEASURES, *_ALL_WEATHER, *PRICE_DOUBLES, *SUPPLY_NAMES["f11_supply_features"], *SUPPLY_NAMES["f12_share_features"],
     "is_extreme_cold", "is_mild_cold", "is_freezing", "temperature_squared", *GROUPS["f9_wind_features"], *GROUPS["f10_sky_features"], "wind_chill"]
)


@query(
    "f16_training_dataset",
    f"{F13_SQL}\n    MAIN SELECT * FROM f13 WHERE price_eur_mwh IS NOT NULL AND {NULLS_SQL} <= {null_limit(F13_COLUMNS)}",
    rounded=F13_DOUBLES,
)
def _(t):
    return _training(t)


@query(
    "p3_drop_sparse_rows",
    """SELECT time, event_id, consumption_mw, production_mw, wind_mw, nuclear_mw, net_import_mw FROM power
       WHERE CAST(consumption_mw IS NULL AS INTEGER) + CAST(production_mw IS NULL AS INTEGER) + CAST(wind_mw IS NULL AS INTEGER)
             + CAST(nuclear_mw IS NULL AS INTEGER) + CAST(net_import_mw IS NULL AS INTEGER) <= 4""",
)
def _(t):
    return datasets.drop_sparse_rows(t.power.select("time", "event_id", *POWER_MEASURES), 0.6)


@query("p4_known_target", "SELECT time, event_id, consumption_mw FROM power WHERE consumption_mw IS NOT NULL")
def _(t):
    return t.power.select("time", "event_id", C).where(F.col(C).isNotNull())


@query(
    "p5_critical_columns",
    "SELECT time, event_id, temperature_c, pressure_hpa, precipitation_mm FROM weather WHERE precipitation_mm IS NOT NULL AND temperature_c IS NOT NULL",
)
def _(t):
    rows = t.weather.select("time", "event_id", "temperature_c", "pressure_hpa", "precipitation_mm")
    return datasets.require_values(rows, ["precipitation_mm", "temperature_c", "not_there"])


F17_SQL = f"""{W8_SQL}, {HOLIDAYS_SQL.strip()}, pw AS ({PIVOT_SQL.replace("WHERE forecast_type IN", f"WHERE forecast_time BETWEEN TIMESTAMP '{FUTURE_START}' AND TIMESTAMP '{FUTURE_END}' AND forecast_type IN")})
    MAIN SELECT fut.*, pw.* EXCLUDE (forecast_time), w8.* EXCLUDE (forecast_time), {CLOCK_SQL.format('fut.forecast_time')}, {CYCLIC_SQL.format('fut.forecast_time')},
        {holiday_flags('fut.forecast_time')}, {WEATHER_SQL.format(**FORECAST)},
        {supply_sql('consumption_forecast_mw', 'production_forecast_mw', 'wind_forecast_mw')}
    FROM fut LEFT JOIN pw USING (forecast_time) LEFT JOIN w8 USING (forecast_time)"""
F17_DOUBLES = " ".join(["temperature wind_speed precipitation_mm", *PRICE_DOUBLES, CYCLIC, WEATHER_DOUBLES, *SUPPLY_DOUBLES[:3],
                      "consumption_forecast_mw production_forecast_mw wind_forecast_mw"])


def _prediction(t):
    return datasets.prediction_dataset(
        t.weather_forecasts, t.forecasts, t.prices, FUTURE_START, FUTURE_END, station_id="s1"
    )


query("f17_prediction_dataset", F17_SQL, rounded=F17_DOUBLES)(_prediction)

F14_SQL = f"""
    WITH h AS (SELECT time, concat('s', user_id % 3) AS station_id, area, max(price_eur_mwh) AS price_eur_mwh, false AS future FROM prices
               WHERE time < TIMESTAMP '{FUTURE_START}' GROUP BY ALL),
    wx AS (SELECT DISTINCT ON (forecast_time, station_id) forecast_time, station_id, temperature_c AS temperature, wind_speed_ms AS wind_speed,
                  wind_direction, cloud_cover, humidity_percent AS humidity, pressure_hpa AS pressure, precipitation_mm, forecast_model, generated_at
           FROM weather_forecasts WHERE forecast_time >= TIMESTAMP '{FUTURE_START}' ORDER BY forecast_time, station_id, generated_at DESC),
    pw AS ({PIVOT_SQL.replace("WHERE forecast_type IN", f"WHERE forecast_time >= TIMESTAMP '{FUTURE_START}' AND forecast_type IN")}),
    fut AS (SELECT wx.*, pw.* EXCLUDE (forecast_time), area FROM wx LEFT JOIN pw USING (forecast_time), (SELECT DISTINCT area FROM prices)),
    u AS (SELECT *, {PRICE_FRAMES_SQL.replace('ORDER BY time', 'PARTITION BY station_id, area ORDER BY time, future')} FROM (
              SELECT time, station_id, area, price_eur_mwh, future FROM h
              UNION ALL SELECT forecast_time, station_id, area, NULL, true FROM fut)),
    w8 AS (SELECT time AS forecast_time, * EXCLUDE (time, price_eur_mwh, future), {DIFFS_SQL} FROM u WHERE future),
    {HOLIDAYS_SQL.strip()}
    MAIN SELECT fut.*, w8.* EXCLUDE (forecast_time, station_id, area), {CLOCK_SQL.format('fut.forecast_time')}, {CYCLIC_SQL.format('fut.forecast_time')},
        {holiday_flags('fut.forecast_time')}, {WEATHER_SQL.format(**FORECAST)},
        {supply_sql('consumption_forecast_mw', 'production_forecast_mw', 'wind_forecast_mw')}
    FROM fut LEFT JOIN w8 USING (forecast_time, station_id, area)"""


@query("f14_prediction_features", F14_SQL, rounded=F17_DOUBLES)
def _(t):
    """Features of the newest forecasts of all stations for all areas; the prices of a station and area are a series."""
    first = F.lit(FUTURE_START).cast("timestamp_ntz")
    coming = lambda df: df.where(F.col("forecast_time") >= first)
    weather_rows = latest_per_key(coming(t.weather_forecasts), ["forecast_time", "station_id"], ["generated_at"])
    known_types = coming(t.forecasts).where(F.col("forecast_type").isin(*joins.FORECAST_TYPES))
    power = joins.pivot_power_forecasts(latest_per_key(known_types, ["forecast_time", "forecast_type"], ["generated_at"]))
    rows = datasets.rename_present(weather_rows, FEATURE_NAMES).join(power, "forecast_time", "left")
    known = t.prices.where(F.col("time") < first).withColumn("station_id", F.concat(F.lit("s"), F.col("user_id") % 3))
    areas = bounded_broadcast(cut(t.prices.select("area").distinct()))
    return datasets.prediction_features(rows.crossJoin(areas), known, keys=["station_id", "area"])


@query(
    "j6_history_on_forecasts",
    f"""{W8_SQL}
    MAIN SELECT w.forecast_time, w.station_id, w.temperature_c, w8.* EXCLUDE (forecast_time, price_lag_168h)
    FROM weather_forecasts w LEFT JOIN w8 USING (forecast_time)""",
    rounded=" ".join(["temperature_c", *[c for c in PRICE_DOUBLES if c != "price_lag_168h"]]),
)
def _(t):
    """Features of the hours of one station's forecasts, joined back to the forecast rows of all."""
    hours = _stub_hours(t)
    first = moment(t.prices, "time", FUTURE_START)
    known = t.prices.where((F.col("area") == "FI") & (F.col("time") < first) & (F.col("time") >= shift_time(first, -720)))
    features = history.add_price_history_to_future(hours, known).drop("price_lag_168h")
    rows = t.weather_forecasts.select("forecast_time", "station_id", "temperature_c")
    return history.join_history(rows, features, "forecast_time")


TARGET_FRAMES = lag_sql(C, C, SQL_TARGET_LAGS, "ORDER BY timestamp") + ", " + rolling_sql(C, C, SQL_WINDOWS, "ORDER BY timestamp", False)
_JOINED = POWER_MEASURES + ["temperature", "wind_speed", "wind_direction", "cloud_cover", "humidity", "pressure", "precipitation_mm"]
F18_SQL = f"""
    WITH {HOLIDAYS_SQL}, q14 AS ({Q14_SQL}),
    al AS (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS timestamp, {', '.join(f'avg({c}) AS {c}' for c in _JOINED)} FROM q14 GROUP BY 1),
    fr AS (SELECT *, {TARGET_FRAMES} FROM al)
    MAIN SELECT *, {F1_SQL.format('timestamp')}, {holiday_flags('timestamp')}, {F6_SQL.format(t='temperature')},
           {CHILL.format(t='temperature', w='wind_speed')} AS wind_chill
    FROM fr WHERE consumption_mw IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND wind_speed IS NOT NULL AND pressure IS NOT NULL"""
F18_DOUBLES = " ".join([
    *_JOINED, *[f"{C}_lag_{n}h" for n in SQL_TARGET_LAGS], *rolling_names(C),
    "heating_degree_days cooling_degree_days temperature_squared wind_chill",
])


@query("f18_consumption_training_table", F18_SQL, rounded=F18_DOUBLES)
def _(t):
    return datasets.consumption_training_table(t.power, t.weather, START, END)


@query(
    "f15_consumption_features",
    f"""WITH {HOLIDAYS_SQL}, h AS (SELECT time AS timestamp, consumption_mw FROM hourly), fr AS (SELECT *, {TARGET_FRAMES} FROM h)
    MAIN SELECT *, {F1_SQL.format('timestamp')}, {holiday_flags('timestamp')} FROM fr WHERE consumption_mw IS NOT NULL""",
    rounded=" ".join([C, *[f"{C}_lag_{n}h" for n in SQL_TARGET_LAGS], *rolling_names(C)]),
)
def _(t):
    rows = t.hourly.select(F.col("time").alias("timestamp"), C)
    return datasets.consumption_features(rows, max_rows=SPLIT_ROWS)


@query(
    "p9_align_names",
    """SELECT event_id, temperature_c, temperature_c AS temperature, wind_speed_ms, wind_speed_ms AS wind_speed, humidity_percent,
              humidity_percent AS humidity, pressure_hpa, pressure_hpa AS pressure FROM weather""",
)
def _(t):
    return models.align_names(t.weather.select("event_id", "temperature_c", "wind_speed_ms", "humidity_percent", "pressure_hpa"))


@query(
    "p1_conditional_rename",
    "SELECT event_id, temperature_c AS temperature, pressure_hpa AS pressure, cloud_cover FROM weather",
)
def _(t):
    from seriesmill.schemas import FEATURE_NAMES

    return datasets.rename_present(t.weather.select("event_id", "temperature_c", "pressure_hpa", "cloud_cover"), FEATURE_NAMES)


# --- rules and scalar functions -------------------------------------------------------------

RULE_SQL = """
    SELECT event_id, concat_ws('; ', CASE WHEN t < -50 THEN 'temperature_c below -50' END, CASE WHEN t > 50 THEN 'temperature_c above 50' END,
        CASE WHEN h < 0 THEN 'humidity_percent below 0' END, CASE WHEN h > 100 THEN 'humidity_percent above 100' END,
        CASE WHEN c < 0 THEN 'cloud_cover below 0' END, CASE WHEN c > 8 THEN 'cloud_cover above 8' END) AS reasons
    FROM (SELECT event_id, temperature_c * 4 AS t, humidity_percent * 1.5 AS h, cloud_cover * 1.2 AS c FROM weather)"""


def _ruled(t):
    return t.weather.select(
        "event_id", (F.col("temperature_c") * 4).alias("temperature_c"),
        (F.col("humidity_percent") * 1.5).alias("humidity_percent"), (F.col("cloud_cover") * 1.2).alias("cloud_cover"),
    )


@query("p12_rejected_rows", f"SELECT * FROM ({RULE_SQL}) WHERE reasons <> ''")
def _(t):
    return rules.rejected_rows(_ruled(t)).select("event_id", F.concat_ws("; ", "reasons").alias("reasons"))


@query("p12_valid_rows", f"SELECT event_id FROM ({RULE_SQL}) WHERE reasons = ''")
def _(t):
    return rules.valid_rows(_ruled(t)).select("event_id")


@query(
    "p12_prediction_rules",
    """SELECT model_type, count(*) AS rejected FROM predictions
       WHERE NOT (predicted_consumption_mw * 1.15 BETWEEN confidence_lower AND confidence_upper) GROUP BY 1""",
)
def _(t):
    shifted = t.predictions.withColumn("predicted_consumption_mw", F.col("predicted_consumption_mw") * 1.15)
    return rules.rejected_rows(shifted).groupBy("model_type").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "f19_time_buckets",
    """SELECT event_id, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS quarter_hour,
              CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        *[floor_time(t.events, "ts", w).alias(n) for w, n in (("15 minutes", "quarter_hour"), ("1 hour", "hour"), ("1 day", "day"))],
    )


@query(
    "f20_date_parts",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(isodow(ts) AS INTEGER) AS iso_weekday,
              CAST(month(ts) AS INTEGER) AS month FROM events""",
)
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.hour(ts).alias("hour"), (F.dayofweek(ts) - 1).alias("dow"), weekday(ts).alias("iso_weekday"),
        F.month(ts).alias("month"),
    )


@query(
    "f21_text_functions",
    """SELECT event_id, hour(ts) || ':00' AS label, 'Hour: ' || hour(ts) || ':00' AS prefixed, substring(props, 1, 5) AS preview,
              coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'unknown') AS version FROM events""",
)
def _(t):
    label = F.concat(F.hour("ts").cast("string"), F.lit(":00"))
    return t.events.select(
        "event_id", label.alias("label"), F.concat(F.lit("Hour: "), label).alias("prefixed"),
        F.substring("props", 1, 5).alias("preview"),
        F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("unknown")).alias("version"),
    )


@query(
    "f22_math_functions",
    """SELECT event_id, abs(value - 50) AS distance, pow(value - 50, 2) AS squared, sqrt(value) AS root,
              CAST(round(CAST(value / 3 AS DECIMAL(38,10)), 2) AS DOUBLE) AS third, 100 / nullif(value, 0) AS inverse,
              value BETWEEN 10 AND 20 AS inside FROM events""",
    rounded="distance squared root inverse",
)
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", F.abs(v - 50).alias("distance"), F.pow(v - 50, F.lit(2)).alias("squared"), F.sqrt(v).alias("root"),
        F.round((v / 3).cast("decimal(38,10)"), 2).cast("double").alias("third"),
        (100 / F.nullif(v, F.lit(0.0))).alias("inverse"), v.between(10, 20).alias("inside"),
    )


@query(
    "f24_interval_arithmetic",
    f"""SELECT event_id, ts - INTERVAL 36 HOUR AS earlier, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR AS recent FROM events""",
)
def _(t):
    recent = F.col("ts") >= shift_time(moment(t.events, "ts", AS_OF), -36)
    return t.events.select("event_id", shift_time(F.col("ts"), -36).alias("earlier"), recent.alias("recent"))


@query(
    "f25_parse_and_format",
    """SELECT event_id, date_trunc('second', ts) AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS formatted, true AS junk_is_null FROM events""",
)
def _(t):
    text = payloads.format_time(F.col("ts"))
    out = t.events.select(
        "event_id", payloads.parse_time(text).alias("parsed"), text.alias("formatted"),
        payloads.parse_time(F.col("event_type")).isNull().alias("junk_is_null"),
    )
    return naive(out, "parsed")


# --- choice of columns ----------------------------------------------------------------------


def _known_values(df, names):
    """One row per feature with the number of its values."""
    marks = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).isNotNull().alias("known")) for n in names))
    return df.select(F.explode(marks).alias("m")).groupBy("m.feature").agg(F.count_if("m.known").alias("known_values"))


@query(
    "p7_feature_columns",
    """SELECT 'area' AS feature, count(area) AS known_values FROM prices
       UNION ALL SELECT 'price_type', count(price_type) FROM prices UNION ALL SELECT 'event_id', count(event_id) FROM prices""",
)
def _(t):
    """All columns but times, target and station names, and but the named extra."""
    return _known_values(t.prices, datasets.feature_names(t.prices, ["user_id"]))


@query("p8_columns_by_prefix", "SELECT time, wind_speed_ms, wind_direction, temperature_c FROM weather", rounded="wind_speed_ms wind_direction temperature_c")
def _(t):
    return datasets.with_prefix(t.weather, ["wind_", "temperature"], keep=["time"])


@query(
    "p10_price_feature_columns",
    """SELECT 'event_id' AS feature, count(event_id) AS known_values FROM power
       UNION ALL SELECT 'user_id', count(user_id) FROM power
       UNION ALL SELECT 'consumption_forecast_mw', count(consumption_mw) FROM power
       UNION ALL SELECT 'production_forecast_mw', count(production_mw) FROM power
       UNION ALL SELECT 'wind_forecast_mw', count(wind_mw) FROM power""",
)
def _(t):
    """Columns that a price model may use: prediction names, without those known only afterwards."""
    aligned = models.align_names(t.power)
    return _known_values(aligned, models.price_features_of(aligned))


@query(
    "p16_numeric_columns",
    """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS timestamp, avg(price_eur_mwh) AS price_eur_mwh, avg(event_id) AS event_id,
              avg(user_id) AS user_id FROM prices GROUP BY 1""",
    rounded="price_eur_mwh event_id user_id",
)
def _(t):
    """Text columns have no mean and are left out."""
    return align_to_hourly(t.prices)


@query(
    "p22_present_weather",
    """SELECT time, temperature_c, pressure_hpa
       FROM (SELECT DISTINCT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time FROM power)
       LEFT JOIN (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, avg(temperature_c) AS temperature_c, avg(pressure_hpa) AS pressure_hpa
                  FROM weather WHERE station_id = (SELECT arg_min(station_id, time) FROM weather) GROUP BY 1) USING (time)""",
    rounded="temperature_c pressure_hpa",
)
def _(t):
    """Weather with two of its measures only: those are joined, no other is asked for."""
    weather = t.weather.select("time", "station_id", "temperature_c", "pressure_hpa")
    return datasets.hourly_inputs(t.power, t.prices, weather).select("time", "temperature_c", "pressure_hpa")
