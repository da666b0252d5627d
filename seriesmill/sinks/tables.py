"""Stored tables: date-partitioned Parquet, upsert, insert-if-absent, append, retention, refresh.

Upserts rewrite only the date partitions that the batch touches.  The merge reads the old
partitions and replaces them at job commit, so a lost executor only repeats its tasks.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.functions.timecols import moment
from seriesmill.operators.latest import first_per_key, latest_per_key
from seriesmill.schemas import KEYS, PARTITION_TIME, POWER_MEASURES, RETENTION_DAYS, TABLES
from seriesmill.session import BROADCAST_ROWS, cut, folder_values

DATE = "date"

# Accepted input names and the stored ones.
POWER_ALIASES = {"timestamp": "time", "consumption": "consumption_mw", "production": "production_mw", "net_import": "net_import_mw"}
PREDICTION_ALIASES = {
    "timestamp": "prediction_time", "yhat": "predicted_price_eur_mwh", "yhat_lower": "confidence_lower",
    "yhat_upper": "confidence_upper",
}


def conform(
    df: DataFrame, table: str, aliases: dict[str, str] | None = None, constants: dict | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Renames aliases, sets constants, adds missing columns as NULL and takes the stored
    order and types.  Times keep their zone-less type if they come with one.  `extra` columns
    (an ingest order, for example) are carried along."""
    aliases = {k: v for k, v in (aliases or {}).items() if k in df.columns and v not in df.columns}
    df = df.withColumnsRenamed(aliases).withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def stored(field):
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType).alias(field.name)
        keep = field.dataType.simpleString() == "timestamp" and kinds[field.name].startswith("timestamp")
        value = F.col(field.name)
        return value if keep else value.cast(field.dataType).alias(field.name)

    return df.select(*[stored(f) for f in TABLES[table].fields], *[c for c in extra if c not in TABLES[table].names])


def whole_oktas(value) -> F.Column:
    """Cloud cover as an integer: NaN becomes NULL, fractions are cut."""
    return F.when(~F.isnan(value.cast("double")), value.cast("double")).cast("int")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None while nothing is stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_days(df: DataFrame, path: str, mode: str, order: Sequence[str]) -> None:
    """One folder per day; rows of a file in key order, which helps Parquet's min/max pruning.

    Rebalancing gathers a day's rows in few tasks but splits a day that is too large for one.
    """
    (
        df.hint("rebalance", F.col(DATE))
        .sortWithinPartitions(DATE, *order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE)
        .parquet(path)
    )


def with_date(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn(DATE, F.to_date(PARTITION_TIME[table]))


def _accepted(batch: DataFrame, table: str) -> DataFrame:
    """The batch, evaluated once, without rows whose time is missing: no key could find them again.
    How many were refused is told in a warning."""
    dated = cut(with_date(batch, table))
    refused = dated.where(F.col(DATE).isNull()).count()
    if refused:
        warnings.warn(f"{table}: {refused} rows without a time were not stored", stacklevel=3)
    return dated.where(F.col(DATE).isNotNull())


def append(df: DataFrame, path: str, table: str) -> None:
    write_days(_accepted(df, table), path, "append", KEYS[table])


def _touched(target: DataFrame, dated_batch: DataFrame) -> DataFrame:
    """Target rows in the date partitions of the batch (other folders are not read)."""
    days = dated_batch.select(DATE).distinct()
    if days.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        days = F.broadcast(days)
    return target.join(days, DATE, "left_semi")


def upsert(batch: DataFrame, path: str, table: str, replaced: Sequence[str], order: Sequence[str] = ()) -> None:
    """Insert or replace by key.  Within a batch the last row by `order` wins.  On conflict
    only the `replaced` columns change; the others (such as `ingested_at`) stay."""
    keys = KEYS[table]
    extra = [c for c in order if c not in TABLES[table].names]
    stored_names = [*TABLES[table].names, DATE]
    ranked = list(order) or [c for c in TABLES[table].names if c not in keys]
    dated = _accepted(batch, table)
    newest = latest_per_key(dated, keys, ranked).drop(*extra).select(*stored_names)
    old = read_table(batch.sparkSession, path)
    if old is None:
        write_days(newest, path, "append", keys)
        return
    kept = [c for c in stored_names if c not in keys and c not in replaced]
    both = _touched(old.select(*stored_names), dated).withColumn("__new", F.lit(0)).unionByName(
        newest.withColumn("__new", F.lit(1))
    )
    # At most two rows per key: the values of the newer one, the kept columns of the older one.
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*replaced), F.col("__new")).alias("__r"),
        F.min_by(F.struct(*kept), F.col("__new")).alias("__k"),
    ).select(*keys, "__r.*", "__k.*").select(*stored_names)
    write_days(merged, path, "overwrite", keys)


def insert_if_absent(batch: DataFrame, path: str, table: str, order: Sequence[str] = ()) -> tuple[int, int]:
    """Appends rows whose key is not stored yet; the first row of a key in the batch wins.
    Returns (rows offered, rows stored)."""
    keys = KEYS[table]
    stored_names = [*TABLES[table].names, DATE]
    ranked = list(order) or [c for c in TABLES[table].names if c not in keys]
    dated = _accepted(batch, table)
    first = first_per_key(dated, keys, ranked).select(*stored_names)
    old = read_table(batch.sparkSession, path)
    new = first if old is None else first.join(_touched(old, dated).select(*keys), keys, "left_anti")
    new = cut(new)
    write_days(new, path, "append", keys)
    return dated.count(), new.count()


# --- the tables ---------------------------------------------------------------------------


def store_power(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    batch = conform(df, "power_actuals", POWER_ALIASES, extra=order)
    upsert(batch, path, "power_actuals", POWER_MEASURES, order)


def store_prices(
    df: DataFrame, path: str, *, area: str = "FI", price_type: str = "imbalance", source: str = "fingrid",
    order: Sequence[str] = (),
) -> tuple[int, int]:
    """The first row of a key by `order` is stored."""
    constants = {"area": area, "price_type": price_type, "source": source}
    batch = conform(df, "price_actuals", {"timestamp": "time"}, constants, extra=order)
    return insert_if_absent(batch, path, "price_actuals", order)


def store_weather(
    df: DataFrame, path: str, station_id: str | None = None, data_type: str = "observation", order: Sequence[str] = (),
) -> None:
    """The last row of a key by `order` is stored."""
    constants = {"data_type": data_type} | ({"station_id": station_id} if station_id is not None else {})
    if "cloud_cover" in df.columns:
        df = df.withColumn("cloud_cover", whole_oktas(F.col("cloud_cover")))
    batch = conform(df, "weather_observations", {"timestamp": "time"}, constants, extra=order)
    measures = [c for c in TABLES["weather_observations"].names if c in (
        "temperature_c", "humidity_percent", "wind_speed_ms", "wind_direction", "pressure_hpa",
        "precipitation_mm", "cloud_cover",
    )]
    upsert(batch, path, "weather_observations", measures, order)


def store_weather_forecast(df: DataFrame, path: str, *, station_id: str | None, model: str, generated_at: str) -> None:
    """One run: all rows get the same run time."""
    constants = {"forecast_model": model} | ({"station_id": station_id} if station_id is not None else {})
    run = moment(df, "forecast_time" if "forecast_time" in df.columns else "timestamp", generated_at)
    batch = df.withColumn("generated_at", run)
    append(conform(batch, "weather_forecasts", {"timestamp": "forecast_time"}, constants), path, "weather_forecasts")


def store_power_forecast(
    df: DataFrame, path: str, *, generated_at: str, forecast_type: str | None = None, unit: str | None = None,
    update_frequency: str | None = None,
) -> None:
    given = {"forecast_type": forecast_type, "unit": unit, "update_frequency": update_frequency}
    run = moment(df, "forecast_time" if "forecast_time" in df.columns else "timestamp", generated_at)
    batch = df.withColumn("generated_at", run)
    constants = {k: v for k, v in given.items() if v is not None}
    append(conform(batch, "power_forecasts", {"timestamp": "forecast_time"}, constants), path, "power_forecasts")


def store_price_predictions(
    df: DataFrame, path: str, *, model_type: str, generated_at: str, model_version: str | None = None,
    training_end: str | None = None,
) -> None:
    time = "prediction_time" if "prediction_time" in df.columns else "timestamp"
    batch = df.withColumn("generated_at", moment(df, time, generated_at))
    if training_end is not None:
        batch = batch.withColumn("training_end_date", moment(df, time, training_end))
    constants = {"model_type": model_type} | ({"model_version": model_version} if model_version else {})
    append(conform(batch, "price_predictions", PREDICTION_ALIASES, constants), path, "price_predictions")


def store_consumption_predictions(
    df: DataFrame, path: str, *, model_type: str, generated_at: str | None = None, order: Sequence[str] = (),
) -> None:
    """The last row of a key by `order` is stored."""
    if generated_at is not None:
        df = df.withColumn("generated_at", moment(df, "timestamp", generated_at))
    replaced = ["predicted_consumption_mw", "confidence_lower", "confidence_upper", "model_version"]
    batch = conform(df, "consumption_predictions", constants={"model_type": model_type}, extra=order)
    upsert(batch, path, "consumption_predictions", replaced, order)


def snapshot(df: DataFrame, root: str, day: str) -> None:
    """Dated copy; writing the same day again replaces that day only."""
    (
        df.withColumn("snapshot_date", F.to_date(F.lit(day)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date").parquet(root)
    )


def drop_folders(spark: SparkSession, path: str, column: str, expired: Callable[[str], bool]) -> None:
    """Removes `<column>=<value>` folders of a stored table whose value is expired."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and expired(name.removeprefix(f"{column}=")):
            fs.delete(status.getPath(), True)


def apply_retention(spark: SparkSession, path: str, table: str, as_of: str) -> None:
    """Drops the expired date folders; nothing is read or rewritten."""
    if read_table(spark, path) is None:
        return
    oldest = date.fromisoformat(as_of[:10]) - timedelta(days=RETENTION_DAYS[table])
    drop_folders(spark, path, DATE, lambda day: day < oldest.isoformat())


def refresh(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Full refresh of a stored result.  The new version is written next to the old one and
    becomes visible when it is complete; readers of the version before are not disturbed."""
    last = max(map(int, folder_values(spark, path, "version")), default=0)
    compute().withColumn("version", F.lit(last + 1)).write.mode("append").partitionBy("version").parquet(path)
    drop_folders(spark, path, "version", lambda v: int(v) < last)
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest version of a refreshed result; the version is found from folder names."""
    versions = folder_values(spark, path, "version")
    if not versions:
        return None
    return spark.read.parquet(path).where(F.col("version") == max(map(int, versions))).drop("version")


def current_or_refresh(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result, filled first if it never was."""
    stored = current(spark, path)
    return refresh(spark, path, compute) if stored is None else stored
