"""Registered queries: Structured Streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.plans import reports
from seriesmill.registered.base import AS_OF, VIEWS, naive, query
from seriesmill.registered.evaluation import A8_DOUBLES, A8_SQL, read_sketch, sketch_ctes
from seriesmill.registered.temporal import FILL_KEYED
from seriesmill.functions import sketches
from seriesmill.functions.sketches import BUCKET
from seriesmill.functions.states import average, stddev
from seriesmill.operators.resample import power_hourly, prices_daily_state
from seriesmill.schemas import POWER_MEASURES
from seriesmill.session import scratch_path
from seriesmill.sinks import tables
from seriesmill.streaming import rollups
from seriesmill.streaming.carry import forward_fill_batches
from seriesmill.streaming.repairs import RepairableRollup


def event_stream(t):
    """The events file as a stream."""
    return rollups.read_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")


def as_view(t, source, *names):
    """The chain of views over another source than the stored events."""
    for name in names:
        text = VIEWS[name].replace("AS TS)", "AS TIMESTAMP_NTZ)")
        inner = next(s for s in ("events", "points", "power") if f"FROM {s}" in text)
        source = t.spark.sql(text.replace(f"FROM {inner}", "FROM {source}"), source=source)
    return source


def power_stream(t, source=None):
    return as_view(t, event_stream(t) if source is None else source, "points", "power")


@query("r1_hourly_stream", A8_SQL, rounded=A8_DOUBLES)
def _(t):
    path, state = scratch_path(t.spark, "hourly"), scratch_path(t.spark, "state")
    rollups.update_stream(rollups.power_hourly_stream(power_stream(t)), path, state, ["hour"], "hour").awaitTermination()
    return naive(reports.power_hourly_report(rollups.rollup(t.spark, path)), "hour")


@query(
    "r2_daily_stream",
    """SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS day, area, avg(price_eur_mwh) AS avg_price, max(price_eur_mwh) AS max_price,
              min(price_eur_mwh) AS min_price, stddev_samp(price_eur_mwh) AS price_volatility FROM prices GROUP BY 1, 2""",
    rounded="avg_price max_price min_price price_volatility",
)
def _(t):
    return daily_rollup(t).select(
        "day", "area", average("price_stats").alias("avg_price"), "max_price", "min_price",
        stddev("price_stats").alias("price_volatility"),
    )


def daily_rollup(t):
    """The stream counts value buckets; the stored counts give the daily rollup."""
    path, state = scratch_path(t.spark, "daily"), scratch_path(t.spark, "state")
    stream = rollups.prices_daily_stream(as_view(t, event_stream(t), "prices"))
    rollups.update_stream(stream, path, state, ["day", "area", BUCKET], "day").awaitTermination()
    return naive(prices_daily_state(rollups.rollup(t.spark, path)), "day")


@query(
    "r2_daily_sketch_stream",
    sketch_ctes("(SELECT *, CAST(date_trunc('day', time) AS TIMESTAMP) AS day FROM prices)", "day, area", "price_eur_mwh")
    + f"""MAIN SELECT day, area, any_value(level) AS level, {read_sketch(0.5, "median_price")}, {read_sketch(0.95, "p95_price")},
              {read_sketch(0.05, "p05_price")} FROM sketched GROUP BY day, area""",
    rounded="median_price p95_price p05_price",
)
def _(t):
    return daily_rollup(t).select(
        "day", "area", F.col("price_distribution.level").cast("long").alias("level"),
        *[sketches.quantile("price_distribution", q).alias(n)
          for q, n in ((0.5, "median_price"), (0.95, "p95_price"), (0.05, "p05_price"))])


@query("r3_late_rows", A8_SQL, rounded=A8_DOUBLES)
def _(t):
    """A second file holds rows that are 40 days older: too late for the rollup."""
    source, path, state = (scratch_path(t.spark, n) for n in ("late", "hourly", "state"))
    late = t.events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 40 DAYS"))
    for part in (t.events, late):
        part.write.mode("append").parquet(source)
        stream = power_stream(t, rollups.read_stream(t.spark, source, t.events.schema))
        rollups.update_stream(rollups.power_hourly_stream(stream), path, state, ["hour"], "hour").awaitTermination()
    return naive(reports.power_hourly_report(rollups.rollup(t.spark, path)), "hour")


def late_stream(t):
    """Raw table and rollup after a second file of rows that are 40 days older."""
    source, root, raw, state = (scratch_path(t.spark, n) for n in ("late", "repairs", "raw", "state"))
    hourly = RepairableRollup(
        t.spark, root, store=lambda rows: tables.store_power(rows, raw), raw=lambda: tables.read_table(t.spark, raw),
        compute=power_hourly, time="time", bucket="hour", every="1 hour", lateness=rollups.POWER_LATENESS)
    for part in (t.events, t.events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 40 DAYS"))):
        part.write.mode("append").parquet(source)
        stream = power_stream(t, rollups.read_stream(t.spark, source, t.events.schema))
        (
            stream.writeStream.foreachBatch(hourly.batch).option("checkpointLocation", state)
            .trigger(availableNow=True).start().awaitTermination()
        )
    return hourly


@query(
    "r3_stale_hours",
    "SELECT DISTINCT CAST(date_trunc('hour', time - INTERVAL 40 DAY) AS TIMESTAMP) AS hour FROM power",
)
def _(t):
    return naive(late_stream(t).stale().select(F.col("bucket").alias("hour")), "hour")


@query("r3_repaired_rows", A8_SQL.replace("FROM power", """FROM (
        SELECT * FROM power UNION ALL SELECT * REPLACE (time - INTERVAL 40 DAY AS time) FROM power)"""), rounded=A8_DOUBLES)
def _(t):
    """The stale hours are computed again: the rollup is that of all rows."""
    hourly = late_stream(t)
    hourly.repair()
    return naive(reports.power_hourly_report(rollups.rollup(t.spark, hourly.path)), "hour")


@query(
    "r4_complete_hours",
    f"""SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS hour, count(*) AS sample_count, max(consumption_mw) AS max_consumption_mw
       FROM power WHERE time < TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR GROUP BY 1""",
)
def _(t):
    path, state = scratch_path(t.spark, "hourly"), scratch_path(t.spark, "state")
    stream = rollups.power_hourly_stream(rollups.complete_part(power_stream(t), "time", AS_OF))
    rollups.update_stream(stream, path, state, ["hour"], "hour").awaitTermination()
    return naive(rollups.rollup(t.spark, path).select("hour", "sample_count", "max_consumption_mw"), "hour")


@query("r5_upsert_stream", f"SELECT time, {', '.join(POWER_MEASURES)} FROM power")
def _(t):
    """The same file arrives twice; the upsert stores every key once."""
    source, path, state = (scratch_path(t.spark, n) for n in ("twice", "power", "state"))
    for _ in range(2):
        t.events.write.mode("append").parquet(source)
        stream = power_stream(t, rollups.read_stream(t.spark, source, t.events.schema))
        rollups.upsert_stream(stream, state, lambda batch: tables.store_power(batch, path)).awaitTermination()
    return tables.read_table(t.spark, path).select("time", *POWER_MEASURES)


@query("r6_without_repeats", "SELECT time, event_id, price_eur_mwh FROM prices")
def _(t):
    source, path, state = (scratch_path(t.spark, n) for n in ("repeats", "prices", "state"))
    t.events.unionByName(t.events).write.parquet(source)
    stream = as_view(t, rollups.read_stream(t.spark, source, t.events.schema), "prices")
    unique = rollups.without_repeats(stream.select("time", "event_id", "price_eur_mwh"), "time", ["event_id"], "60 days")
    rollups.append_stream(unique, path, state).awaitTermination()
    return naive(t.spark.read.parquet(path), "time")


@query(
    "r7_forward_fill_stream",
    f"SELECT user_id, time, {FILL_KEYED} FROM power",
)
def _(t):
    """Three files in time order; values carry from one micro-batch to the next."""
    source, root, state = (scratch_path(t.spark, n) for n in ("parts", "filled", "state"))
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2025-01-01"]
    for low, high in zip(bounds, bounds[1:]):
        at = F.col("ts")
        part = t.events.where((at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz")))
        part.write.mode("append").parquet(source)
        stream = power_stream(t, rollups.read_stream(t.spark, source, t.events.schema)).drop("event_id")
        fill = forward_fill_batches(root, POWER_MEASURES, keys=["user_id"], time="time")
        stream.writeStream.foreachBatch(fill).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").select("user_id", "time", *POWER_MEASURES)


LATE_KEYED = f"""
    WITH tagged AS (
        SELECT *, time >= TIMESTAMP '2024-01-11' AND time < TIMESTAMP '2024-01-21'
                  AND coalesce(max(CASE WHEN time >= TIMESTAMP '2024-01-21' OR time < TIMESTAMP '2024-01-11' THEN time END)
                               OVER (PARTITION BY user_id) > time, false) AS late
        FROM power
    )
    MAIN SELECT user_id, time, late, {FILL_KEYED} FROM tagged WHERE NOT late
    UNION ALL SELECT user_id, time, late, {", ".join(POWER_MEASURES)} FROM tagged WHERE late"""


@query("r7_late_rows", LATE_KEYED)
def _(t):
    """The second of three files comes last: its rows are late for every series that has gone on."""
    source, root, state = (scratch_path(t.spark, n) for n in ("parts", "filled", "state"))
    fill = forward_fill_batches(root, POWER_MEASURES, keys=["user_id"], time="time")
    for low, high in (("2024-01-01", "2024-01-11"), ("2024-01-21", "2025-01-01"), ("2024-01-11", "2024-01-21")):
        at = F.col("ts")
        part = t.events.where((at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz")))
        part.write.mode("append").parquet(source)
        stream = power_stream(t, rollups.read_stream(t.spark, source, t.events.schema)).drop("event_id")
        stream.writeStream.foreachBatch(fill).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows, late = (t.spark.read.parquet(f"{root}/{n}").select("user_id", "time", *POWER_MEASURES) for n in ("rows", "late"))
    both = rows.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("user_id", "time", "late", *POWER_MEASURES)


@query(
    "r8_latest_run_stream",
    """SELECT DISTINCT ON (timestamp, model_type) timestamp, model_type, predicted_consumption_mw, generated_at
       FROM predictions ORDER BY timestamp, model_type, generated_at DESC""",
)
def _(t):
    path, state = scratch_path(t.spark, "runs"), scratch_path(t.spark, "state")
    stream = as_view(t, event_stream(t), "predictions")
    newest = rollups.latest_run_stream(stream, ["timestamp", "model_type"], "generated_at", ["predicted_consumption_mw"],
                                       time="timestamp", lateness="7 days")
    rollups.update_stream(newest, path, state, ["timestamp", "model_type"], "timestamp").awaitTermination()
    return naive(rollups.rollup(t.spark, path), "timestamp")
