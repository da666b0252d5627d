"""Streaming forward fill: the batch operator per micro-batch, with a state table by hash folder.

The state holds the last known value of each column per series.  Series are dealt over folders by a
hash of their keys, and a micro-batch reads and writes only the folders of the series that it
touches: `<root>/state/batch=<b>/part=<p>` is folder p as batch b left it.  A batch starts from the
newest folders of earlier batches, so a repeated batch gives the same result.  A long series inside
a micro-batch is split like in a batch job.

A row older than its series' state came too late to be filled in its place: it goes to
`<root>/late`, unfilled, for a batch run over that stretch of time to repair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.operators.joins import forward_fill
from seriesmill.operators.ordered import MAX_ROWS
from seriesmill.session import cut, folder_values
from seriesmill.sinks.tables import drop_folders

BATCH, PART = "batch", "part"
# Folders of the state; a micro-batch rewrites the series of those it touches.
PARTS = 64


def state_folders(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """For each part of the state the batches that wrote it, oldest first."""
    written: dict[int, list[int]] = {}
    for batch in sorted(map(int, folder_values(spark, path, BATCH))):
        for part in map(int, folder_values(spark, f"{path}/{BATCH}={batch}", PART)):
            written.setdefault(part, []).append(batch)
    return written


def forward_fill_batches(
    root: str, columns: Sequence[str], *, keys: Sequence[str], time: str = "timestamp",
    required: str | None = None, max_rows: int = MAX_ROWS, parts: int = PARTS,
) -> Callable[[DataFrame, int], None]:
    """Function for `foreachBatch`: appends filled rows to `<root>/rows`, late ones to `<root>/late`.

    Rows before the first `required` value are left out of the result; they count for the state.
    """
    rows_path, state_path, late_path = f"{root}/rows", f"{root}/state", f"{root}/late"
    columns, keys = list(columns), list(keys)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.select(*keys, time, *columns)).withColumn("__old", F.lit(False))
        touched = [r[0] for r in rows.select(part).distinct().collect()]  # at most `parts`
        written = state_folders(spark, state_path)
        last = {p: max((b for b in written.get(p, []) if b < batch_id), default=None) for p in touched}
        known_parts = [f"{state_path}/{BATCH}={b}/{PART}={p}" for p, b in last.items() if b is not None]
        late = rows.limit(0)
        if known_parts:
            before = spark.read.schema(rows.drop("__old").schema).parquet(*known_parts)
            same = [rows[k].eqNullSafe(before[k]) for k in keys]
            known = rows.join(before.select(*keys, F.col(time).alias("__since")), same, "left").select(rows["*"], "__since")
            is_late = F.coalesce(F.col(time) < F.col("__since"), F.lit(False))
            late = known.where(is_late).drop("__since")
            rows = known.where(~is_late).drop("__since").unionByName(
                before.select(*keys, time, *columns).withColumn("__old", F.lit(True)))
        filled = cut(forward_fill(rows, columns, time=time, keys=keys, required=None, max_rows=max_rows))
        # The newest row of a series after filling is its next state.
        state = filled.groupBy(*keys).agg(F.max_by(F.struct(time, *columns), F.col(time)).alias("s"))
        fresh = filled.where(~F.col("__old"))
        if required is not None:
            fresh = fresh.where(F.col(required).isNotNull())
        for frame, path, folders in (
            (state.select(*keys, "s.*").withColumn(PART, part), state_path, [BATCH, PART]),
            (fresh.drop("__old"), rows_path, [BATCH]), (late.drop("__old"), late_path, [BATCH]),
        ):
            (
                frame.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
            )
        # A repeated batch needs the folder before its own; older ones are never read again.
        for p, newest in last.items():
            for old in written.get(p, []):
                if newest is not None and old < newest:
                    drop_folders(spark, f"{state_path}/{BATCH}={old}", PART, lambda n, p=p: int(n) == p)
        for old in {b for held in written.values() for b in held}:
            if not folder_values(spark, f"{state_path}/{BATCH}={old}", PART):
                drop_folders(spark, state_path, BATCH, lambda n, old=old: int(n) == old)

    return run
