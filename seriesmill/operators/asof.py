"""As-of joins: tag both sides, union them, carry the right side along, keep the left rows.

The alternative, a lateral join with an inequality and LIMIT 1, is planned as a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seriesmill.functions.timecols import micros
from seriesmill.operators.ordered import OWN, PIECE, Pieces, carry, split, time_cells

_TIME, _SIDE, _LEFT, _RIGHT = "__t", "__side", "__left", "__right"


def _tagged(left, right, left_time, right_time, keys):
    """Right rows sort before left rows of the same time, so an equal time matches."""
    series = [f"__s{i}" for i in range(len(keys))]
    rows = left.select(
        *[F.col(k).alias(s) for k, s in zip(keys, series)],
        F.col(left_time).alias(_TIME),
        F.lit(1).alias(_SIDE),
        F.struct(*left.columns).alias(_LEFT),
    )
    carried = [c for c in right.columns if c not in keys]
    known = right.select(
        *[F.col(k).alias(s) for k, s in zip(keys, series)],
        F.col(right_time).alias(_TIME),
        F.lit(0).alias(_SIDE),
        F.struct(*carried).alias(_RIGHT),
    )
    return rows.unionByName(known, allowMissingColumns=True), series


def _both_keys(left, right, keys, series):
    """Key columns of both sides: as many rows per series as the union has, or more."""
    names = [(F.col(k).alias(s)) for k, s in zip(keys, series)]
    return left.select(*names).unionByName(right.select(*names))


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str = "time",
    right_time: str = "time",
    keys: Sequence[str] = (),
    columns: Sequence[str],
    max_age: str | None = None,
    matched_time: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Left outer: each left row with the newest right row at or before its time.

    Several right rows of one time count as one: the largest in column order.
    """
    right = right.select(*keys, right_time, *columns)
    union, series = _tagged(left, right, left_time, right_time, keys)
    found = carry(
        union, [_TIME, _SIDE, _RIGHT], series, {"__match": ("last", _RIGHT)},
        cells=time_cells(_TIME), max_rows=max_rows, bound=_both_keys(left, right, keys, series),
    ).where(F.col(_SIDE) == 1)
    at = F.col(f"__match.{right_time}")
    usable = F.lit(True) if max_age is None else at >= F.col(_TIME) - F.expr(f"INTERVAL {max_age}")
    extra = [F.when(usable, at).alias(matched_time)] if matched_time else []
    return found.select(
        f"{_LEFT}.*", *extra, *[F.when(usable, F.col(f"__match.{c}")).alias(c) for c in columns]
    )


def _nearest_rows(union: DataFrame, series: Sequence[str], pieces: Pieces) -> DataFrame:
    """Adds `__before` and `__after`, the nearest right rows on both sides of each left row.

    Both frames share one partitioning and sort the rows once each way (an unbounded-following frame
    would need no second sort but costs quadratic time).  Of right rows of one time both take the
    largest: it is the last one in either order.  In a split series the right rows alone are read once
    more, for the first and the last of each piece.
    """
    split_up = pieces.table is not None
    rows = pieces.assign(union).drop(OWN) if split_up else union
    parts = [*series, PIECE] if split_up else list(series)
    forth = Window.partitionBy(*parts).orderBy(F.col(_TIME).asc(), F.col(_SIDE).asc(), F.col(_RIGHT).asc())
    back = Window.partitionBy(*parts).orderBy(F.col(_TIME).desc(), F.col(_SIDE).desc(), F.col(_RIGHT).asc())
    upto = lambda w: F.last(_RIGHT, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("*", upto(forth).alias("__before"), upto(back).alias("__after"))
    if not split_up:
        return found
    known = pieces.assign(union.where(F.col(_RIGHT).isNotNull())).where(F.col(OWN))
    ends = known.groupBy(*series, PIECE).agg(
        F.max_by(_RIGHT, F.struct(_TIME, _RIGHT)).alias("newest"),
        F.max_by(_RIGHT, F.struct(-micros(F.col(_TIME)), F.col(_RIGHT))).alias("oldest"))
    last = lambda c: F.last(c, ignorenulls=True)
    return pieces.with_carried(found, pieces.carried(ends, {"newest": last}, {"oldest": last})).withColumns({
        "__before": F.coalesce("__before", "__c_newest"), "__after": F.coalesce("__after", "__c_oldest")})


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str = "time",
    right_time: str = "time",
    keys: Sequence[str] = (),
    columns: Sequence[str],
    tolerance: str = "30 minutes",
    required: str | None = None,
    matched_time: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Each left row with the nearest right row within the closed tolerance.

    Equal distances go to the later right row; several right rows of one time count as one, the
    largest in column order.  With `required`, left rows whose match lacks
    that column are dropped (this includes rows without a match).
    """
    right = right.select(*keys, right_time, *columns)
    union, series = _tagged(left, right, left_time, right_time, keys)
    pieces = split(union, series, time_cells(_TIME), max_rows=max_rows, bound=_both_keys(left, right, keys, series))
    both = _nearest_rows(union, series, pieces).where(F.col(_SIDE) == 1)
    t = micros(F.col(_TIME))
    before = t - micros(F.col(f"__before.{right_time}"))
    after = micros(F.col(f"__after.{right_time}")) - t
    reach = F.expr(f"INTERVAL {tolerance}")
    later = after.isNotNull() & (before.isNull() | (after <= before))
    picked = both.withColumn("__match", F.when(later, F.col("__after")).otherwise(F.col("__before")))
    at = F.col(f"__match.{right_time}")
    within = (at >= F.col(_TIME) - reach) & (at <= F.col(_TIME) + reach)
    extra = [F.when(within, at).alias(matched_time)] if matched_time else []
    joined = picked.select(
        f"{_LEFT}.*", *extra, *[F.when(within, F.col(f"__match.{c}")).alias(c) for c in columns]
    )
    return joined.where(F.col(required).isNotNull()) if required else joined
