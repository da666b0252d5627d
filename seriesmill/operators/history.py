"""Lag, rolling and difference features over ordered series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seriesmill.operators.ordered import join_null_safe, with_frames
from seriesmill.session import bounded_broadcast, cut

# Default lags and windows, in rows.
TARGET_LAGS = (1, 3, 6, 12, 24, 48, 168)
PRICE_LAGS = (1, 2, 3, 24, 48, 168)
WINDOWS = (6, 12, 24, 168)

Framed = dict[str, Callable[[WindowSpec], Column]]


def lag_columns(source: str, prefix: str, lags: Sequence[int]) -> Framed:
    """`<prefix>_lag_<n>h`: the value n rows earlier (rows, not hours: gaps shift it)."""
    return {f"{prefix}_lag_{n}h": (lambda w, n=n: F.lag(source, n).over(w)) for n in lags}


def rolling_columns(source: str, prefix: str, windows: Sequence[int], full: bool) -> Framed:
    """Mean, std, min and max over the n rows that end at the current row.  With `full`, a
    window that lacks any of its n values gives NULL."""
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def framed(measure, n):
        def column(w):
            frame = w.rowsBetween(-(n - 1), 0)
            value = measure(source).over(frame)
            return F.when(F.count(source).over(frame) == n, value) if full else value
        return column

    return {
        f"{prefix}_rolling_{name}_{n}h": framed(measure, n)
        for n in windows for name, measure in measures.items()
    }


def add_target_history(
    df: DataFrame, target: str = "consumption_mw", *, time: str = "timestamp", keys: Sequence[str] = (),
    lags: Sequence[int] = TARGET_LAGS, windows: Sequence[int] = WINDOWS, **limits,
) -> DataFrame:
    """Lags and rolling statistics of the target; one value is enough for a window.  `limits`
    are those of `split`: max_rows, bound, at_most."""
    columns = lag_columns(target, target, lags) | rolling_columns(target, target, windows, full=False)
    return with_frames(
        df, [time], keys, columns, look_back=max([*lags, *windows, 1]), **limits
    )


def price_frames(price: str, lags: Sequence[int], windows: Sequence[int]) -> Framed:
    return lag_columns(price, "price", lags) | rolling_columns(price, "price", windows, full=True)


def add_price_differences(df: DataFrame) -> DataFrame:
    """Hourly and daily price change from the lag columns that exist."""
    new = {}
    for name, newer, older in (
        ("price_diff_1h", "price_lag_1h", "price_lag_2h"),
        ("price_diff_24h", "price_lag_24h", "price_lag_48h"),
    ):
        if newer in df.columns and older in df.columns:
            new[name] = F.col(newer) - F.col(older)
    return df.withColumns(new) if new else df


def add_price_history(
    df: DataFrame, price: str = "price_eur_mwh", *, time: str = "time", keys: Sequence[str] = (),
    lags: Sequence[int] = PRICE_LAGS, windows: Sequence[int] = WINDOWS, **limits,
) -> DataFrame:
    """Price lags, full-window rolling statistics and differences."""
    framed = with_frames(
        df, [time], keys, price_frames(price, lags, windows),
        look_back=max([*lags, *windows, 1]), **limits,
    )
    return add_price_differences(framed)


def reachable_history(known: DataFrame, future: DataFrame, keys: Sequence[str], look_back: int) -> DataFrame:
    """The rows of `known`, one per series and `__time`, that frames of the future rows reach: the newest
    `look_back` of those before the first future row of their series, and all later ones.

    A row without a time is older than all others, in both tables.
    """
    first = future.groupBy(*keys).agg(
        F.when(F.count("__time") == F.count(F.lit(1)), F.min("__time")).alias("__first"), F.count(F.lit(1)).alias("__rows"),
    ).where(F.col("__rows") > 0).drop("__rows")
    marked = join_null_safe(known, bounded_broadcast(cut(first)), keys)
    older = F.coalesce(F.col("__time") < F.col("__first"), F.col("__time").isNull() & F.col("__first").isNotNull())
    newest = Window.partitionBy(*keys).orderBy(F.col("__time").desc())
    before = marked.where(older).withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= look_back)
    return before.unionByName(marked.where(~older), allowMissingColumns=True).drop("__rank", "__first")


def add_price_history_to_future(
    df: DataFrame, history: DataFrame, *, time: str = "forecast_time", keys: Sequence[str] = (),
    lags: Sequence[int] = PRICE_LAGS, windows: Sequence[int] = WINDOWS, max_rows: int | None = None,
) -> DataFrame:
    """Price history features for rows whose price is not known yet.

    Future rows enter the series with a NULL price and carry their own columns along, so no
    join back is needed.  Several history rows of one time count as one (the highest price).
    Only future rows are returned, so frames are computed over the history that theirs reach.
    """
    known = history.groupBy(*keys, F.col("time").alias("__time")).agg(
        F.max("price_eur_mwh").alias("__price")
    ).withColumn("__future", F.lit(False))
    future = df.select(
        *keys, F.col(time).alias("__time"), F.lit(None).cast("double").alias("__price"),
        F.lit(True).alias("__future"), F.struct(*df.columns).alias("__row"),
    )
    columns = price_frames("__price", lags, windows)
    look_back = max([*lags, *windows, 1])
    reached = reachable_history(known, future, keys, look_back)
    framed = with_frames(
        cut(reached.unionByName(future, allowMissingColumns=True)), ["__time", "__future"], keys, columns,
        look_back=look_back, max_rows=max_rows,
    )
    return add_price_differences(framed.where(F.col("__future")).select("__row.*", *columns))


def join_history(rows: DataFrame, features: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Price-history features, one row per time (and keys), joined back to forecast rows; rows without
    features keep NULLs, and columns that both sides have stay those of the rows."""
    on = [time, *keys]
    new = [c for c in features.columns if c in on or c not in rows.columns]
    return rows.join(features.select(*new), on, "left").select(*rows.columns, *[c for c in new if c not in on])
