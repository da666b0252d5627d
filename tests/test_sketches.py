"""Relative-error sketches against a plain version, merged parts against the whole."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import sketches

BASE = sketches.log_base()


def plain(values, limit):
    """(level, [(side, index, n)] in the order of the values)."""
    counts = Counter()
    for v in values:
        if v is not None and math.isfinite(v):
            side = (v > 0) - (v < 0)
            counts[side, math.ceil(math.log(abs(v)) / BASE) if v else 0] += 1
    level = 0
    while limit is not None and len(counts) > limit:
        level, joined = level + 1, Counter()
        for (side, i), n in counts.items():
            joined[side, math.ceil(i / 2)] += n
        counts = joined
    return level, [(s, i, n) for (s, i), n in sorted(counts.items(), key=lambda x: (x[0][0], x[0][0] * x[0][1]))]


def decoded(sketch):
    out = []
    for b in sketch.buckets:
        side = (b.bucket + (1 << 39)) >> 40
        out.append((side, side * (b.bucket - (side << 40)), b.n))
    return sketch.level, out


def frame(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double").repartition(3)


def groups():
    draw = random.Random(6)
    return {
        "prices": [draw.uniform(-50, 200) for _ in range(800)], "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(500)],
        "same": [3.5] * 90, "zero": [0.0, -0.0, 0.0], "one": [-7.25], "none": [None, float("nan"), float("inf")],
        "small": [draw.uniform(-1, 1) for _ in range(300)] + [None, float("-inf")],
    }


@pytest.mark.parametrize("limit", [sketches.LIMIT, 7, None])
def test_packed_against_plain(spark, limit):
    held = groups()
    counts = sketches.bucket_counts(frame(spark, held), ["g"], "v")
    got = {r.g: decoded(r.sketch) for r in sketches.pack(counts, ["g"], limit=limit).collect()}
    assert got == {g: plain(v, limit) for g, v in held.items() if g != "none"}


@pytest.mark.parametrize("limit", [sketches.LIMIT, 7])
def test_merged_parts_are_the_whole(spark, limit):
    held = groups()
    rows = frame(spark, held).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(5)))
    counts = sketches.bucket_counts(rows, ["g", "part"], "v")
    parts = sketches.pack(counts, ["g", "part"], limit=limit)
    merged = parts.groupBy("g").agg(sketches.merge("sketch", limit).alias("sketch"))
    got = {r.g: decoded(r.sketch) for r in merged.collect()}
    assert got == {g: plain(v, limit) for g, v in held.items() if g != "none"}


def test_quantiles_are_within_the_bound(spark):
    held = groups()
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    read = [sketches.quantile("sketch", q).alias(f"q{k}") for k, q in enumerate(shares)]
    for limit in (sketches.LIMIT, None):
        packed = sketches.pack(sketches.bucket_counts(frame(spark, held), ["g"], "v"), ["g"], limit=limit)
        for r in packed.select("g", sketches.bound("sketch").alias("bound"), sketches.count("sketch").alias("n"), *read).collect():
            values = sorted(v for v in held[r.g] if v is not None and math.isfinite(v))
            assert r.n == len(values) and (limit is not None or math.isclose(r.bound, 0.001))
            for k, q in enumerate(shares):
                exact = values[math.floor(q * (len(values) - 1))]
                assert abs(r[f"q{k}"] - exact) <= r.bound * 1.000001 * abs(exact)


def test_nothing_counted(spark):
    rows = frame(spark, {"none": [None, float("nan")]})
    one = rows.groupBy("g", sketches.bucket(F.col("v")).alias("bucket")).agg(F.count("v").alias("n")).groupBy("g").agg(
        sketches.packed().alias("sketch"))
    assert one.select(sketches.quantile("sketch", 0.5)).first()[0] is None
    assert sketches.pack(sketches.bucket_counts(rows.limit(0), ["g"], "v"), ["g"]).count() == 0
