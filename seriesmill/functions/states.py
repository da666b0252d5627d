"""Mergeable aggregate states: (n, mean, m2) statistics.

Partial results of any grain can be stored and merged to a coarser grain without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stats_state(value: Column) -> Column:
    """Aggregate: count, mean and sum of squared deviations of the non-NULL values."""
    n = F.count(value)
    return F.struct(
        n.alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * n).alias("m2"),
    )


def merge_states(state: str) -> Column:
    """Aggregate: one state for many states held in a column."""
    n, mean, m2 = (F.col(f"{state}.{f}") for f in ("n", "mean", "m2"))
    total = F.sum(n)
    # Spread of the partial means, weighted by their counts, around the overall mean.
    overall = F.sum(n * mean) / F.nullif(total, F.lit(0))
    between = F.sum(n * mean * mean) - total * overall * overall
    return F.struct(
        total.alias("n"),
        overall.alias("mean"),
        (F.sum(m2) + F.greatest(between, F.lit(0.0))).alias("m2"),
    )


def average(state: str) -> Column:
    return F.col(f"{state}.mean")


def variance(state: str) -> Column:
    """Sample variance; NULL for fewer than two values."""
    n = F.col(f"{state}.n")
    return F.when(n > 1, F.col(f"{state}.m2") / (n - 1))


def stddev(state: str) -> Column:
    return F.sqrt(variance(state))
