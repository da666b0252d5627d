"""Exact grouped quantiles that do not hold a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmill.operators.ordered import join_null_safe, rows_per_piece
from seriesmill.session import bounded_broadcast, cut

_ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], max_rows: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Interpolated quantiles of `value` per group (name to share), NULLs ignored.

    The groups and values are evaluated once and written, unless `df` is `written` already.  Small groups use the built-in exact
    percentile, which keeps the distinct values of a group in memory.  If a group is larger than
    `max_rows`, an approximate percentile with a proven rank error first brackets all answers; the
    brackets, one row per group, go to the rows, and only the values inside a bracket are put in order.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("__v"))
    rows = rows if written else cut(rows)
    sizes = rows.groupBy(*keys).agg(F.count("__v").alias("__n"))
    if sizes.where(F.col("__n") > rows_per_piece(df.sparkSession, max_rows)).isEmpty():
        shares = F.array(*[F.lit(float(q)) for q in wanted.values()])
        found = rows.groupBy(*keys).agg(F.percentile("__v", shares).alias("__q"))
        return found.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(wanted)])
    return _bracketed(rows, keys, wanted)


def _bracketed(rows: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    margin, shares = 4.0 / _ACCURACY, list(wanted.values())
    around = F.array(*[F.lit(min(max(q + side * margin, 0.0), 1.0)) for q in shares for side in (-1, 1)])
    brackets = cut(rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.percentile_approx("__v", around, F.lit(_ACCURACY)).alias("__b")))

    # For each share a value is below the bracket, inside it or above.  The values on a side fold into one
    # row per group and task, with the value next to the bracket; equal values inside do too.
    v, b = F.col("__v"), F.col("__b")
    placed = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(v < b[2 * i], -1).when(v > b[2 * i + 1], 1).otherwise(0).alias("side"))
        for i in range(len(shares))
    ])
    known = join_null_safe(rows.where(v.isNotNull()), bounded_broadcast(brackets), keys)
    sided = known.select(*keys, "__n", "__v", F.explode(placed).alias("__p"))
    counted = sided.groupBy(*keys, "__p.i", "__p.side", F.when(F.col("__p.side") == 0, v).alias("inside")).agg(
        F.count(F.lit(1)).alias("c"), F.max("__v").alias("most"), F.min("__v").alias("least"), F.any_value("__n").alias("n")
    ).withColumn("v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))

    order = Window.partitionBy(*keys, "i").orderBy("side", "v")
    share = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("i") + 1)
    ranked = counted.withColumn("upto", F.sum("c").over(order)).withColumn("place", (F.col("n") - 1) * share)

    def at(rank: Column) -> Column:
        first = F.col("upto") - F.col("c")
        here = (F.col("upto") > rank) & (first <= rank)
        near = (F.col("side") == 0) | ((F.col("side") < 0) & (rank == F.col("upto") - 1)) | ((F.col("side") > 0) & (rank == first))
        missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
        return F.max(F.when(here & near, F.col("v")).when(here, missed))

    found = ranked.groupBy(*keys, "i").agg(
        at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.any_value("place").alias("place"))
    part = F.col("place") - F.floor("place")
    found = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * part)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(wanted)])
    # Groups without a value are there too.
    return join_null_safe(brackets.select(*keys), wide, keys, "left")
