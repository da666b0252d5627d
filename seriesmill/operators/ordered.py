"""Ordered work over keyed series that stays spread over the cluster.

A window over one series is one task's work.  That is right while every series is small,
and it is what happens here when no series exceeds `max_rows`.  A longer series (or a table
without any key) is cut into pieces of about `max_rows` rows:

* rows are counted per *cell*, a narrow interval of the order column (one minute by default; a
  cell with too many rows is divided into seconds, then milliseconds);
* a running sum over the cell counts gives each cell its row offset, and offset / max_rows is
  its piece.  The sum has two levels, wide ranges of cells and the cells of each range, so that the
  cells of one series need not meet in one task.  Only cells of long series are counted, and only
  they are split;
* frames that look back a fixed number of rows (`with_frames`) get the cells that hold those
  rows copied into the piece, so every piece is complete by itself;
* frames that look back without bound (`carry`) get one carried value per piece instead, made
  from one aggregated row per piece and joined to the rows after their frame.

Both need one shuffle of the rows, on (series, piece).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from seriesmill.session import BROADCAST_ROWS, bounded_broadcast, cut

MAX_ROWS = 2_000_000
# Cells of long series; a cell that is too large is divided into cells of the next grain.
GRAINS = ("minute", "second", "millisecond")
# Number of long series or large cells that are listed on the driver and broadcast.
LISTED_ROWS = 10_000

PIECE = "__piece"
OWN = "__own"
CELL_COLUMN = "__cell"
RANGE = "__range"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match, like in GROUP BY; the right keys are dropped."""
    if not keys:  # a global aggregate on the right: one row
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, reduce(lambda a, b: a & b, on), how).drop(*[f"__j{i}" for i in range(len(keys))])


def rows_per_piece(spark: SparkSession, max_rows: int | None) -> int:
    return int(max_rows or spark.conf.get("seriesmill.maxRowsPerPiece", str(MAX_ROWS)))


class Cells(list):
    """Cells from wide to narrow, and the range of a cell: a coarser interval, in the same order."""

    def __init__(self, cells: Sequence[Column], range_of: Callable[[Column], Column]):
        super().__init__(cells)
        self.range_of = range_of


def time_cells(time: str) -> Cells:
    return Cells([F.date_trunc(grain, F.col(time)) for grain in GRAINS], lambda cell: F.date_trunc("day", cell))


def value_cells(value: str, width: float) -> Cells:
    cells = [F.floor(F.col(value) / F.lit(w)) * F.lit(w) for w in (width, width / 1000)]
    return Cells(cells, lambda cell: F.floor(cell / F.lit(1000 * width)))


def running_count(counts: DataFrame, keys: Sequence[str], range_of: Callable[[Column], Column]) -> DataFrame:
    """Adds `__end`, the rows of all cells of a series up to this one: ranges before this one, and the
    cells of its own range."""
    ranged = counts.withColumn(RANGE, range_of(F.col(CELL_COLUMN)))
    totals = ranged.groupBy(*keys, RANGE).agg(F.sum("__n").alias("__all"))
    upto = F.sum("__all").over(Window.partitionBy(*keys).orderBy(RANGE))
    before = totals.select(*keys, RANGE, (upto - F.col("__all")).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy(*keys, RANGE).orderBy(CELL_COLUMN))
    return join_null_safe(ranged.withColumn("__within", within), before, [*keys, RANGE]).withColumn(
        "__end", F.col("__before") + F.col("__within")).drop("__before", "__within", RANGE)


def _listed(rows: DataFrame) -> DataFrame | None:
    """A table that is expected to be short: None if empty, broadcast if it is short indeed,
    and left as a table to be joined if it is not."""
    found = rows.limit(LISTED_ROWS + 1).collect()
    if not found:
        return None
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)) if len(found) <= LISTED_ROWS else rows


@dataclass(frozen=True)
class Pieces:
    """Which cells of which long series belong to which pieces (`None`: nothing to split)."""

    table: DataFrame | None
    keys: tuple[str, ...]
    cells: tuple[Column, ...] = ()
    # Per grain but the last: the cells that are divided further.
    divided: tuple[DataFrame, ...] = ()
    # No more pieces than this in all long series together.
    at_most: int = 0

    def mark(self, df: DataFrame) -> DataFrame:
        """Adds the cell of each row."""
        out = df.withColumn(CELL_COLUMN, self.cells[0])
        for large, finer in zip(self.divided, self.cells[1:]):
            out = join_null_safe(out, large, [*self.keys, CELL_COLUMN], "left").withColumn(
                CELL_COLUMN, F.when(F.col("__large"), finer).otherwise(F.col(CELL_COLUMN))
            ).drop("__large")
        return out

    def assign(self, df: DataFrame) -> DataFrame:
        """Adds piece and ownership; a row may appear in a later piece as look-back."""
        whole = F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.lit(True).alias("own")))
        return (
            join_null_safe(self.mark(df), self.table, [*self.keys, CELL_COLUMN], "left")
            .withColumn("__to", F.explode(F.coalesce(F.col("__targets"), whole)))
            .select(*df.columns, F.col("__to.piece").alias(PIECE), F.col("__to.own").alias(OWN))
        )

    def carried(
        self, totals: DataFrame, before: dict[str, Callable[[Column], Column]], after: dict[str, Callable[[Column], Column]] | None = None
    ) -> DataFrame:
        """For each piece what the pieces before it, and those after it, hand on.

        totals: one row per piece that has any, with the named columns.  `before` and `after` combine the
        rows of several pieces, in their order or against it, e.g. to the last value.
        """
        keys = list(self.keys)
        own = self.table.select(*keys, F.explode("__targets").alias("__to")).where("__to.own").select(
            *keys, F.col("__to.piece").alias(PIECE)).distinct()
        rows = join_null_safe(own, totals, [*keys, PIECE], "left")
        frames = [
            (columns, Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
            for columns, order in ((before, F.col(PIECE).asc()), (after or {}, F.col(PIECE).desc()))
        ]
        return rows.select(*keys, PIECE, *[f(F.col(n)).over(w).alias(f"__c_{n}") for columns, w in frames for n, f in columns.items()])

    def with_carried(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        """Adds the handed-on values to the rows of each piece: a join with one row per piece."""
        small = F.broadcast(carried) if self.at_most <= BROADCAST_ROWS else carried
        return join_null_safe(rows, small, [*self.keys, PIECE], "left")


def split(
    df: DataFrame,
    keys: Sequence[str],
    cells: Sequence[Column],
    *,
    look_back: int = 0,
    max_rows: int | None = None,
    bound: DataFrame | None = None,
    at_most: int | None = None,
) -> Pieces:
    """Measures the series and cuts the long ones.

    `cells` are intervals of the order column from wide to narrow.  The measuring jobs read
    only the keys and the order column; at most rows / max_rows series or cells can be too
    long.  `at_most` is a known limit of the rows per series, which can make measuring
    needless.  `bound` is a cheaper table with at least as many rows per series; the rows
    themselves are counted only if it has a long series.
    """
    limit = max(rows_per_piece(df.sparkSession, max_rows), look_back)
    keys = list(keys)
    if at_most is not None and at_most <= limit:
        return Pieces(None, tuple(keys))

    def longer(counted: DataFrame, names: Sequence[str], flag: str) -> DataFrame | None:
        sizes = counted.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
        return _listed(sizes.where(F.col("__n") > limit).select(*names, F.lit(True).alias(flag)))

    for table in ([df] if bound is None else [bound, df]):
        long_series = longer(table, keys, "__long")
        if long_series is None:
            return Pieces(None, tuple(keys))
    rows = join_null_safe(df, long_series, keys, "left_semi") if keys else df

    pieces = Pieces(None, tuple(keys), tuple(cells))
    for _ in cells[1:]:
        large = longer(pieces.mark(rows), [*keys, CELL_COLUMN], "__large")
        if large is None:
            break
        pieces = replace(pieces, divided=(*pieces.divided, large))

    # From here on the data are cell counts of the long series only.
    counts = cut(pieces.mark(rows).groupBy(*keys, CELL_COLUMN).agg(F.count(F.lit(1)).alias("__n")))
    # A long series has more than `limit` rows, so n rows make 2 n / limit pieces at most.
    at_most = 2 * (counts.agg(F.sum("__n")).first()[0] or 0) // limit
    range_of = getattr(cells, "range_of", lambda cell: F.lit(0))
    offsets = running_count(counts, keys, range_of).withColumn(
        "__start", F.col("__end") - F.col("__n")
    ).withColumn("piece", F.floor(F.col("__start") / F.lit(limit)))

    # A piece may be short when a wide cell precedes it, so look-back can reach over it into
    # the piece before, but never further: piece p starts at p * limit rows or later.
    by_piece = Window.partitionBy(*keys).orderBy("piece")
    starts = (
        offsets.groupBy(*keys, "piece")
        .agg(F.min("__start").alias("__first"))
        .select(
            *keys,
            "piece",
            *[F.lead(c, n).over(by_piece).alias(f"{c}_{n}") for c in ("piece", "__first") for n in (1, 2)],
        )
    )
    targets = F.array(
        F.struct(F.col("piece"), F.lit(True).alias("own")),
        *[
            F.when(
                F.col(f"__first_{n}") < F.col("__end") + F.lit(look_back),
                F.struct(F.col(f"piece_{n}").alias("piece"), F.lit(False).alias("own")),
            )
            for n in (1, 2)
        ],
    )
    placed = join_null_safe(offsets, starts, [*keys, "piece"])
    table = cut(placed.select(*keys, CELL_COLUMN, F.array_compact(targets).alias("__targets")))
    return replace(pieces, table=bounded_broadcast(table), at_most=at_most)


def with_frames(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    *,
    look_back: int,
    cells: Sequence[Column] | None = None,
    max_rows: int | None = None,
    bound: DataFrame | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Adds columns whose frames reach at most `look_back` rows back.

    All columns share one partitioning and one order, so they cost one shuffle and one sort.
    """
    pieces = split(
        df, keys, cells or time_cells(order[0]), look_back=look_back, max_rows=max_rows, bound=bound, at_most=at_most
    )
    if pieces.table is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[f(window).alias(name) for name, f in columns.items()])
    window = Window.partitionBy(*keys, PIECE).orderBy(*order)
    return (
        pieces.assign(df)
        .select("*", *[f(window).alias(name) for name, f in columns.items()])
        .where(F.col(OWN))
        .drop(PIECE, OWN)
    )


def carry(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str],
    columns: dict[str, tuple[str, str]],
    *,
    backwards: bool = False,
    cells: Sequence[Column] | None = None,
    max_rows: int | None = None,
    pieces: Pieces | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Adds columns that depend on all earlier rows (all later rows with `backwards`).

    `columns` maps a new name to (kind, source): kind `last` carries the latest non-NULL
    value up to and including the row, kind `sum` is the running total.  `pieces` reuses the
    split of an earlier step over the same rows.
    """
    if pieces is None:
        pieces = split(df, keys, cells or time_cells(order[0]), max_rows=max_rows, bound=bound)
    direction = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    combine = {
        "last": lambda c: F.last(c, ignorenulls=True),
        "sum": F.sum,
    }
    if pieces.table is None:
        upto = Window.partitionBy(*keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[combine[kind](source).over(upto).alias(n) for n, (kind, source) in columns.items()]
        )

    position = F.struct(*[F.col(c) for c in order])
    newest = F.min_by if backwards else F.max_by
    reduce_piece = {
        # NULL order values are ignored, so this picks the latest row that has a value.
        "last": lambda c: newest(F.col(c), F.when(F.col(c).isNotNull(), position)),
        "sum": F.sum,
    }
    join = {
        "last": lambda own, handed: F.coalesce(own, handed),
        "sum": lambda own, handed: F.coalesce(own + handed, own, handed),
    }
    # Pieces are summed up before their rows are shuffled, from the rows that have a value.
    sources = sorted({source for _, source in columns.values()})
    valued = df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in sources]))
    totals = pieces.assign(valued).where(F.col(OWN)).groupBy(*keys, PIECE).agg(
        *[reduce_piece[k](c).alias(n) for n, (k, c) in columns.items()])
    handed = {n: combine[k] for n, (k, _) in columns.items()}
    carried = pieces.carried(totals, {}, handed) if backwards else pieces.carried(totals, handed)
    upto = Window.partitionBy(*keys, PIECE).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    framed = pieces.assign(df).select(
        *df.columns, PIECE, *[combine[k](c).over(upto).alias(f"__w_{n}") for n, (k, c) in columns.items()])
    return pieces.with_carried(framed, carried).select(
        *df.columns, *[join[k](F.col(f"__w_{n}"), F.col(f"__c_{n}")).alias(n) for n, (k, _) in columns.items()])
