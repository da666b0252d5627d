"""Newest row per key, newest run, de-duplication and first/last known values.

All of them are `max_by` / `min_by` aggregates: partial aggregation shrinks a hot key on the
map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesmill.session import bounded_broadcast, cut


def _pick(df: DataFrame, keys: Sequence[str], order: Column, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(chooser(row, order).alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest `order` columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return _pick(df, keys, F.struct(*[F.col(c) for c in order]), F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest `order` columns."""
    return _pick(df, keys, F.struct(*[F.col(c) for c in order]), F.min_by)


def latest_run_rows(df: DataFrame, run: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of the newest run (per key): one small aggregate joined back to the rows."""
    if not keys:
        newest = df.agg(F.max(run).alias("__newest"))
        return df.join(F.broadcast(newest), df[run] == newest["__newest"]).drop("__newest")
    # One row per key, written once: it is counted and joined.
    newest = cut(df.groupBy(*keys).agg(F.max(run).alias("__newest")))
    return df.join(bounded_broadcast(newest), list(keys)).where(F.col(run) == F.col("__newest")).select(*df.columns)


def latest_predictions_per_model(df: DataFrame) -> DataFrame:
    """Per model: the rows of its newest run, one per timestamp."""
    newest = latest_run_rows(df, "generated_at", ["model_type"])
    return latest_per_key(newest, ["model_type", "timestamp"], ["generated_at"])


def current_weather(df: DataFrame) -> DataFrame:
    """Newest observation per station."""
    return latest_per_key(df.where(F.col("data_type") == "observation"), ["station_id"], ["time"])


def last_known(df: DataFrame, time: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Values of the last row of each series; a NULL in that row stays NULL."""
    values = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max_by(values, F.col(time)).alias("__v")).select(*keys, "__v.*")


def status(df: DataFrame) -> DataFrame:
    """The newest stored prediction row: by run, then by time."""
    return df.orderBy(F.col("generated_at").desc(), F.col("timestamp").desc()).limit(1)
