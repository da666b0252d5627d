"""Decoding of JSON payload columns into rows.

A payload is parsed once.  Its body comes out of a generator, which the optimizer does not inline into
the filters and columns above it.  What cannot be decoded is told with its reason by `rejected_*`:
every payload is either decoded or rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

POINTS_JSON = (
    "struct<data: array<struct<startTime: string, endTime: string, start_time: string, "
    "end_time: string, value: double>>, __raw: string>"
)
WEATHER_JSON = "map<string, map<string, map<string, struct<value: double, units: string>>>>"

# Parameter names of the weather source, per column.
OBSERVATION_PARAMETERS = {
    "temperature": "Air temperature",
    "humidity": "Relative humidity",
    "wind_speed": "Wind speed",
    "wind_direction": "Wind direction",
    "pressure": "Pressure (msl)",
    "precipitation": "Precipitation amount",
    "cloud_cover": "Cloud amount",
}
# Forecast payloads name some of them differently, depending on their shape.
FORECAST_BY_TIME_PARAMETERS = OBSERVATION_PARAMETERS | {
    "humidity": "Humidity",
    "pressure": "Air pressure",
    "cloud_cover": "Total cloud cover",
}
FORECAST_BY_STATION_PARAMETERS = OBSERVATION_PARAMETERS | {
    "temperature": "Temperature",
    "pressure": "Pressure",
    "cloud_cover": "Total cloud cover",
}
STATION_ID_FIELDS = ("fmisid", "FMISID", "station_id", "stationId", "id")


def parse_time(text: Column) -> Column:
    """ISO time with `Z`, an offset or none (then UTC); NULL if it is not a time."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def format_time(time: Column) -> Column:
    """UTC text to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Reasons of a rejected payload.
MISSING, UNREADABLE, EMPTY, OTHER_STATION = "missing", "unreadable", "empty", "no reading of the station"


def _parsed_once(df: DataFrame, payload: str, kind: str, options: dict | None = None) -> DataFrame:
    """Adds the parsed payload as `__body`."""
    return df.withColumn("__body", F.explode(F.array(F.from_json(payload, kind, options or {}))))


def _parsed_points(df: DataFrame, payload: str) -> DataFrame:
    """Adds `__body` and `__reason` (NULL for a payload with points)."""
    parsed = _parsed_once(df, payload, POINTS_JSON, {"columnNameOfCorruptRecord": "__raw"})
    return parsed.withColumn(
        "__reason",
        F.when(F.col(payload).isNull(), MISSING)
        .when(F.col("__body").isNull() | F.col("__body.__raw").isNotNull(), UNREADABLE)
        .when(F.coalesce(F.size("__body.data"), F.lit(0)) < 1, EMPTY))


def _rejected(parsed: DataFrame, df: DataFrame) -> DataFrame:
    return parsed.where(F.col("__reason").isNotNull()).select(*df.columns, F.col("__reason").alias("reason"))


def decode_points(df: DataFrame, payload: str) -> DataFrame:
    """One row per point of an electricity payload; other columns are kept.

    Camel-case and snake-case keys are accepted, unknown keys are ignored.
    """
    rest = [c for c in df.columns if c != payload]
    return (
        _parsed_points(df, payload).where(F.col("__reason").isNull())
        .withColumn("__p", F.explode("__body.data"))
        .select(
            *rest,
            parse_time(F.coalesce("__p.start_time", "__p.startTime")).alias("start_time"),
            parse_time(F.coalesce("__p.end_time", "__p.endTime")).alias("end_time"),
            F.col("__p.value").alias("value"),
        )
    )


def rejected_points(df: DataFrame, payload: str) -> DataFrame:
    """The electricity payloads that give no point, whole and with the reason."""
    return _rejected(_parsed_points(df, payload), df)


def points_to_frame(points: DataFrame, column: str = "consumption_mw", keys: tuple[str, ...] = ()) -> DataFrame:
    return points.select(*keys, F.col("start_time").cast("timestamp").alias("timestamp"), F.col("value").alias(column))


def weather_to_frame(rows: DataFrame) -> DataFrame:
    """Decoded weather under storage names (with units)."""
    units = {
        "temperature": "temperature_c", "humidity": "humidity_percent", "wind_speed": "wind_speed_ms",
        "pressure": "pressure_hpa", "precipitation": "precipitation_mm",
    }
    return rows.withColumnsRenamed({k: v for k, v in units.items() if k in rows.columns})


def _parsed_weather(df: DataFrame, payload: str, station: str, station_name: str, forecast: bool) -> DataFrame:
    """Adds `__by_station` (its shape), `__readings` (time -> parameter -> reading of the station) and
    `__reason` (NULL for a payload with readings)."""
    body, sid, name = F.col("__body"), F.col(station), F.col(station_name)
    first = F.lit(1)

    def is_time(key):
        return parse_time(key).isNotNull()

    def has_times(m):
        return F.exists(F.map_keys(m), is_time)

    if forecast:
        by_station_shape = ~has_times(body)
        by_station = F.try_element_at(F.filter(F.map_values(body), has_times), first)
    else:
        by_station_shape = F.map_contains_key(body, sid)
        by_station = F.try_element_at(body, sid)

    def chosen(stations: Column) -> Column:
        names = F.map_keys(stations)
        exact = F.when(F.map_contains_key(stations, name), name)
        if forecast:
            key = F.coalesce(exact, F.try_element_at(names, first))
        else:
            same = F.filter(names, lambda k: F.lower(k) == F.lower(name))
            only = F.when(F.size(names) == 1, F.try_element_at(names, first))
            key = F.coalesce(exact, only, F.try_element_at(same, F.lit(-1)), F.try_element_at(names, first))
        return F.try_element_at(stations, key)

    by_time = F.transform_values(body, lambda _, stations: chosen(stations))
    shape = F.coalesce(by_station_shape, F.lit(False))
    found = F.struct(shape.alias("by_station"), F.when(shape, by_station).otherwise(by_time).alias("readings"))
    # The readings, too, are worked out once, behind a generator.
    parsed = _parsed_once(df, payload, WEATHER_JSON).withColumn("__found", F.explode(F.array(found)))
    return parsed.select(
        "*",
        F.when(F.col(payload).isNull(), MISSING).when(body.isNull(), UNREADABLE).when(F.size(body) < 1, EMPTY)
        .when(F.coalesce(F.size("__found.readings"), F.lit(0)) < 1, OTHER_STATION).alias("__reason"))


def decode_weather(
    df: DataFrame, payload: str, station: str, station_name: str, *, forecast: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Rows (station, timestamp, parameters...) from a nested weather payload.

    Two shapes occur: station -> time -> parameter, and time -> station -> parameter.  An
    observation payload has the first shape when it holds the station's key, a forecast
    payload when none of its outer keys is a time.  In the second shape the station is chosen
    by exact name, then the only one, then (observations) the name in any case, then the first.
    Of several rows of one station and time the last payload (by `order`) wins.
    """
    names_by_time = FORECAST_BY_TIME_PARAMETERS if forecast else OBSERVATION_PARAMETERS
    names_by_station = FORECAST_BY_STATION_PARAMETERS if forecast else OBSERVATION_PARAMETERS
    keep = [station, *([order] if order else [])]
    rows = _parsed_weather(df, payload, station, station_name, forecast).where(F.col("__reason").isNull()).select(
        *keep, F.col("__found.by_station").alias("__shape"), F.explode("__found.readings").alias("__at", "__values"))

    def reading(parameter):
        return F.try_element_at("__values", F.lit(parameter))["value"]

    values = [
        F.when(F.col("__shape"), reading(names_by_station[c])).otherwise(reading(names_by_time[c])).alias(c)
        for c in OBSERVATION_PARAMETERS
    ]
    decoded = rows.select(*keep, parse_time(F.col("__at")).alias("timestamp"), F.struct(*values).alias("__v"))
    newest = F.max_by("__v", order) if order else F.max("__v")
    return decoded.groupBy(station, "timestamp").agg(newest.alias("__v")).select(station, "timestamp", "__v.*")


def rejected_weather(
    df: DataFrame, payload: str, station: str, station_name: str, *, forecast: bool = False
) -> DataFrame:
    """The weather payloads without a reading of their station, whole and with the reason."""
    return _rejected(_parsed_weather(df, payload, station, station_name, forecast), df)


def station_coordinates(metadata: DataFrame, station: str, body: str) -> DataFrame:
    """Coordinates and name of a station from one JSON metadata map per row.

    The entry is found by the station key, by the same number as key, or by an id field of an
    entry.  A `wgs84` text (`lat,lon` or `POINT(lon lat)`) goes before single fields.
    """
    sid = F.col(station)
    entries = F.from_json(body, "map<string, map<string, string>>")
    first = F.lit(1)
    same_number = F.filter(F.map_keys("__e"), lambda k: k.try_cast("bigint") == sid.try_cast("bigint"))
    by_field = F.filter(
        F.map_values("__e"),
        lambda m: F.coalesce(*[F.try_element_at(m, F.lit(f)) for f in STATION_ID_FIELDS]) == sid,
    )
    found = F.coalesce(
        F.try_element_at("__e", sid),
        F.try_element_at("__e", F.try_element_at(same_number, first)),
        F.try_element_at(by_field, first),
    )

    def field(*names):
        return F.coalesce(*[F.try_element_at("__m", F.lit(n)) for n in names])

    def number(text):
        return F.regexp_replace(text, "[() ]", "").try_cast("double")

    text = field("wgs84", "wgs84_center")
    pair = r"^\s*\(?([^,]+),([^,]+)$"
    point = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+([^\s)]+)"
    return (
        metadata.withColumn("__e", entries)
        .withColumn("__m", found)
        .select(
            station,
            F.coalesce(
                number(F.regexp_extract(text, pair, 1)), number(F.regexp_extract(text, point, 2)),
                number(field("latitude", "lat")),
            ).alias("latitude"),
            F.coalesce(
                number(F.regexp_extract(text, pair, 2)), number(F.regexp_extract(text, point, 1)),
                number(field("longitude", "lon")),
            ).alias("longitude"),
            F.coalesce(field("name"), F.lit("Unknown")).alias("station_name"),
        )
    )
