"""Merging of metric series, pivots, existence tests and insert-if-absent keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seriesmill.operators.ordered import carry
from seriesmill.schemas import POWER_MEASURES


def merge_series(
    points: DataFrame,
    metrics: Sequence[str],
    *,
    time: str = "timestamp",
    metric: str = "metric",
    value: str = "value",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Long points to one row per time with a `<metric>_mw` column each (a full outer merge).

    One shuffle for any number of metrics.  Two values of one metric at one time keep the
    larger one.
    """
    wide = [
        F.max(F.when(F.col(metric) == m, F.col(value))).alias(f"{m}_mw") for m in metrics
    ]
    return points.where(F.col(metric).isin(*metrics)).groupBy(*keys, time).agg(*wide)


def merge_frames(frames: dict[str, DataFrame], time: str = "timestamp") -> DataFrame:
    """The same for one frame per metric, each with columns (time, value)."""
    tagged = [f.select(time, "value", F.lit(m).alias("metric")) for m, f in frames.items()]
    return merge_series(reduce(DataFrame.unionByName, tagged), list(frames), time=time)


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    time: str = "timestamp",
    keys: Sequence[str] = (),
    required: str | None = "consumption_mw",
    max_rows: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Each value column carries its last known value; rows before the first `required`
    value are dropped."""
    filled = carry(
        df, [time], keys, {f"__f_{c}": ("last", c) for c in columns}, max_rows=max_rows, bound=bound
    ).select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
    return filled.where(F.col(required).isNotNull()) if required in filled.columns else filled


def merge_and_fill(points: DataFrame, keys: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    metrics = [m.removesuffix("_mw") for m in POWER_MEASURES]
    merged = merge_series(points, metrics, keys=keys)
    return forward_fill(merged, POWER_MEASURES, keys=keys, max_rows=max_rows, bound=points)


FORECAST_TYPES = ("consumption", "production", "wind")


def pivot_power_forecasts(df: DataFrame, types: Sequence[str] = FORECAST_TYPES) -> DataFrame:
    """Long forecasts to `<type>_forecast_mw` columns; one value per (time, type) is expected."""
    return df.where(F.col("forecast_type").isin(*types)).groupBy("forecast_time").agg(
        *[
            F.max(F.when(F.col("forecast_type") == t, F.col("value"))).alias(f"{t}_forecast_mw")
            for t in types
        ]
    )


def any_row(df: DataFrame, condition, name: str) -> DataFrame:
    """One row telling whether the condition holds anywhere."""
    return df.agg(F.coalesce(F.max(condition), F.lit(False)).alias(name))


def absent_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the target does not hold yet."""
    return batch.join(target.select(*keys).distinct(), list(keys), "left_anti")
